"""Product codes of vectors: each vector becomes the numbers of the nearest entries of small codebooks, one for each part of it.

Components become integers floor(scale * x). Vectors are cut into equal parts, and each part position has a codebook of its own,
which starts as that part of the vectors of the least ids and is moved to the means (floored) of the parts assigned to its
entries, round by round. Nearest entries are found in the Walsh-Hadamard domain: parts and entries are padded with zeros to a
power of two P and transformed in integers, which multiplies every squared distance by P exactly. Squared differences are added
up coefficient by coefficient in sequency order (slow sign changes first, where most of the distance is); an entry whose sum is
beyond the whole distance to the best entry so far is out. No floating point takes part once components are integers.

Only sums and counts of entries leave the tasks: (part, entry, position) cells, added up by Spark, of which at most
parts * entries * length reach the driver. Assigning reads the vectors again in each round and keeps nothing.

Vectors that are NULL or empty, or hold NULL or non-finite components, take no part; nor do those of another length than the
vector of the least id (ids ascending, NULL ids last, equal ids by vector). Repeated ids and rows are rows each. Fewer vectors than
entries give smaller codebooks; no vectors give empty codebooks and no rows. Columns of any name may be carried along.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tileframe.llm.common import materialise

#: Rows whose distances to all entries of a codebook are held at once.
SLICE_ROWS = 4096
#: Groups up to this number are broadcast when their sums go back to their rows.
BROADCAST_GROUPS = 100_000


@dataclass(frozen=True)
class Codebooks:
    """entries: parts x entries x length of a part, 64-bit integers; dim: length of the vectors."""

    entries: np.ndarray
    dim: int
    scale: float

    def digest(self) -> str:
        """SHA-256 of all components in decimal by part, entry and position, comma-joined."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def sequency_order(n: int) -> np.ndarray:
    """Rows of the Hadamard matrix of size n (a power of two) by their number of sign changes."""
    matrix = walsh_hadamard(np.eye(n, dtype="int64"), in_order=False)
    return np.argsort((matrix[:, 1:] != matrix[:, :-1]).sum(1), kind="stable")


def walsh_hadamard(x: np.ndarray, in_order: bool = True) -> np.ndarray:
    """Along the last axis, padded with zeros to a power of two; coefficients in sequency order."""
    n = 1 << max(0, x.shape[-1] - 1).bit_length()
    y = np.zeros((*x.shape[:-1], n), "int64")
    y[..., : x.shape[-1]] = x
    half = 1
    while half < n:
        pairs = y.reshape(*y.shape[:-1], n // (2 * half), 2, half)
        y = np.stack([pairs[..., 0, :] + pairs[..., 1, :], pairs[..., 0, :] - pairs[..., 1, :]], -2).reshape(y.shape)
        half *= 2
    return y[..., sequency_order(n)] if in_order else y


def leaders(row: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Where each row (ascending, none missing) first has its least total."""
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    best = np.repeat(np.minimum.reduceat(total, starts), np.diff(np.append(starts, len(row))))
    at = np.flatnonzero(total == best)
    return at[np.unique(row[at], return_index=True)[1]]


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each row (ties to the lower one) and its squared distance; both sides are transformed."""
    first = (x[:, :1] - entries[:, 0]) ** 2
    guess = first.argmin(1)
    bound = ((x - entries[guess]) ** 2).sum(1)
    row, entry = np.nonzero(first <= bound[:, None])
    total = first[row, entry]
    n = x.shape[1]
    for j in range(1, n):
        total = total + (x[row, j] - entries[entry, j]) ** 2
        if 2 * j == n:  # half of the way: the best of what is left gives a lower bound for the rest
            bound = np.minimum(bound, ((x - entries[entry[leaders(row, total)]]) ** 2).sum(1))
        live = total <= bound[row]
        row, entry, total = row[live], entry[live], total[live]
    at = leaders(row, total)
    return entry[at], total[at] // n


def integer_parts(batch: pa.RecordBatch, vector_col: str, dim: int, parts: int, scale: float) -> np.ndarray:
    """Rows x parts x length of the vectors, floored to integers."""
    flat = batch.column(vector_col).flatten().to_numpy(zero_copy_only=False).astype("float64")
    scaled = np.floor(flat * scale)
    padded = 1 << max(0, dim // parts - 1).bit_length()
    most = math.isqrt((1 << 62) // (padded * dim)) // 2
    if len(scaled) and np.abs(scaled).max() > most:
        raise ValueError(f"components beyond {most} / {scale} have no exact squared distance in 64 bits")
    return scaled.astype("int64").reshape(-1, parts, dim // parts)


def assign(x: np.ndarray, transformed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of each row and part."""
    rows, parts, _ = x.shape
    codes, errors = np.empty((rows, parts), "int64"), np.empty((rows, parts), "int64")
    y = walsh_hadamard(x)
    for p in range(parts):
        codes[:, p], errors[:, p] = nearest(y[:, p], transformed[p])
    return codes, errors


def usable(vectors: DataFrame, vector_col: str) -> Column:
    return F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & ~F.exists(vector_col, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))


def fit_codebooks(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = 16, entries: int = 64, rounds: int = 2, scale: float = 256) -> Codebooks:
    """Codebooks after so many rounds over all vectors."""
    if entries > 256:
        raise ValueError("a code has two hexadecimal digits: at most 256 entries")
    x = F.transform(F.col(vector_col).cast("array<double>"), lambda v: F.floor(v * scale).cast("bigint"))
    kept = vectors.where(usable(vectors, vector_col)).select(F.col(id_col).alias("i"), F.size(vector_col).alias("n"), x.alias("x"))
    head = kept.orderBy(F.asc_nulls_last("i"), "x").limit(1).collect()
    if not head:
        return Codebooks(np.empty((parts, 0, 0), "int64"), 0, scale)
    dim = head[0].n
    if dim % parts:
        raise ValueError(f"vectors of {dim} components can't be cut into {parts} equal parts")
    first = kept.where(F.col("n") == dim).orderBy(F.asc_nulls_last("i"), "x").limit(entries).collect()
    books = Codebooks(np.array([r.x for r in first], "int64").reshape(len(first), parts, dim // parts).transpose(1, 0, 2), dim, scale)
    for _ in range(rounds):
        books = moved(vectors, books, vector_col)
    return books


def moved(vectors: DataFrame, books: Codebooks, vector_col: str) -> Codebooks:
    """Each entry at the floored mean of the parts that are nearest to it; unused entries stay."""
    parts, entries, length = books.entries.shape
    dim, scale, transformed = books.dim, books.scale, walsh_hadamard(books.entries)
    schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("place", pa.int32()), ("n", pa.int64()), ("total", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros((parts, entries), "int64"), np.zeros((parts, entries, length), "int64")
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                x = integer_parts(batch.slice(at, SLICE_ROWS), "x", dim, parts, scale)
                codes, _ = assign(x, transformed)
                for p in range(parts):
                    n[p] += np.bincount(codes[:, p], minlength=entries)
                    np.add.at(total[p], codes[:, p], x[:, p])
        p, e = np.nonzero(n)
        cells = [np.repeat(p, length), np.repeat(e, length), np.tile(np.arange(length), len(p)), np.repeat(n[p, e], length), total[p, e].ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, schema.types, strict=True)], schema=schema)

    fit = vectors.where(usable(vectors, vector_col) & (F.size(vector_col) == dim)).select(F.col(vector_col).alias("x"))
    cells = fit.mapInArrow(run, "part int, entry int, place int, n bigint, total bigint").groupBy("part", "entry", "place")
    new = books.entries.copy()
    for r in cells.agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
        new[r.part, r.entry, r.place] = int(r.total) // r.n
    return Codebooks(new, dim, scale)


def encode(vectors: DataFrame, books: Codebooks, keep: dict[str, Column], vector_col: str = "embedding", code: str = "code", error: str = "error") -> DataFrame:
    """The columns of keep, the code (two hexadecimal digits a part) and the squared distance to what the code stands for."""
    parts, dim, scale, transformed = books.entries.shape[0], books.dim, books.scale, walsh_hadamard(books.entries) if books.dim else None
    names = list(keep)
    if {code, error} & set(names) or len(set(names)) < len(names):
        raise ValueError(f"names of kept columns are taken twice: {names}")
    rows = vectors.where(usable(vectors, vector_col) & (F.size(vector_col) == dim)).select(*[c.alias(f"k{i}") for i, c in enumerate(keep.values())], F.col(vector_col).alias("x"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField(code, T.StringType()), T.StructField(error, T.LongType())])
    digits = np.array([f"{i:02x}" for i in range(256)], "S2")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                piece = batch.slice(at, SLICE_ROWS)
                codes, errors = assign(integer_parts(piece, "x", dim, parts, scale), transformed)
                text = np.ascontiguousarray(digits[codes]).view(f"S{2 * parts}").ravel()
                yield pa.RecordBatch.from_arrays([*piece.columns[:-1], pa.array(text, pa.binary()).cast(pa.string()), pa.array(errors.sum(1))], [*piece.schema.names[:-1], code, error])

    return rows.mapInArrow(run, schema).toDF(*names, code, error)


def with_group_sum(coded: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """coded and the sum of value over the rows of its group, NULL groups together. One row a group is summed, written and joined
    back, so that Spark can split a group of many rows; the sums are broadcast if they have been counted to be few."""
    coded = materialise(coded, "coded")
    sums = materialise(coded.groupBy(F.col(group).alias("__group")).agg(F.sum(value).alias("__sum")), "sums")
    if sums.count() <= BROADCAST_GROUPS:
        sums = F.broadcast(sums)
    return coded.join(sums, F.col(group).eqNullSafe(F.col("__group"))).select(*coded.columns, F.col("__sum").alias(name))
