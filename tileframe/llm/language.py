"""Language identification by rank-order profiles.

Each language's profile is its most frequent letter n-grams (n = 1, 2, 3, within words, word ends marked) in order of
frequency. A document's own profile is compared with each by out-of-place distance: the sum, over the document's n-grams, of
the distance between the two ranks, or the profile size where a language lacks the n-gram. The least distance wins; ties go
to the first language by name.

Profiles are fitted on a bounded sample of labelled rows (``max_rows_per_language``, chosen by hash). Whole texts are used.
A NULL text, or one without a letter, is ``und`` with score 0; so is every text when there are no labelled rows. The score
is the relative gap between the best and the second distance, from 0 to 1. Rows are independent; repeated rows stay. An empty table
gives no rows and no profiles. Columns of the input are carried only if asked for (``keep``), which may not hold the names of the results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tileframe.llm.common import slices

UNKNOWN = "und"
#: Bytes of text turned into Python strings at a time.
SLICE_BYTES = 2 << 20
PROFILE = 400


class Letters:
    """Which code points are letters; built once per worker."""

    flags: np.ndarray | None = None

    @classmethod
    def table(cls) -> np.ndarray:
        if cls.flags is None:
            cls.flags = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        return cls.flags


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct 1-, 2- and 3-grams of the letters of a text, as integers of 21 bits a letter, with their counts."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = Letters.table()[points]
    if not letter.any():
        return np.empty(0, "int64"), np.empty(0, "int64")
    points = np.where(letter, points, 0).astype("int64")
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one mark after each word
    marked = np.zeros(int(keep.sum()) + 2, "int64")
    marked[1:-1] = points[keep]
    one = marked[marked > 0]
    two = marked[:-1] << 21 | marked[1:]
    two = two[(marked[:-1] > 0) | (marked[1:] > 0)]
    middle = marked[1:-1] > 0
    three = (marked[:-2] << 42 | marked[1:-1] << 21 | marked[2:])[middle]
    # Word ends are 0: an offset past the code points and a sign keep the three kinds apart.
    coded = np.concatenate([one + 0x110000, -two - 1, three])
    coded.sort()
    at = np.flatnonzero(np.concatenate([[True], coded[1:] != coded[:-1]]))
    return coded[at], np.diff(np.append(at, len(coded)))


def profile(text: str, size: int) -> np.ndarray:
    codes, counts = grams(text)
    return codes[np.argsort(-counts, kind="stable")[:size]]


def fit_profiles(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", size: int = PROFILE, max_rows_per_language: int = 2000) -> dict[str, list[int]]:
    """Profiles of the languages among the rows where ``train`` holds; at most about max_rows_per_language rows of each are read."""
    rows = docs.where(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.lit("profile"), F.col(id_col)).alias("h"))
    shares = rows.groupBy("lang").agg((F.lit(float(max_rows_per_language)) / F.count("*")).alias("share"))
    sample = rows.join(F.broadcast(shares), "lang").where(F.pmod("h", F.lit(1_000_000)) < F.col("share") * 1_000_000)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list] = {}
        for batch in slices(batches, "text", SLICE_BYTES):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found.setdefault(lang, []).append(grams(text))
        for lang, both in found.items():
            codes, back = np.unique(np.concatenate([x for x, _ in both]), return_inverse=True)
            n = np.bincount(back, np.concatenate([x for _, x in both]), len(codes)).astype("int64")
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes), pa.array(n)], ["lang", "code", "n"])

    counts = sample.select("lang", "text").mapInArrow(count, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    top = counts.withColumn("place", F.row_number().over(best)).where(F.col("place") <= size)
    out: dict[str, list[int]] = {}
    for row in top.orderBy("lang", "place").collect():  # size rows for each language
        out.setdefault(row.lang, []).append(row.code)
    return out


class Ranks:
    def __init__(self, profiles: dict[str, list[int]], size: int):
        self.size, self.langs = size, sorted(profiles)
        self.codes = np.unique(np.concatenate([np.array(profiles[x], "int64") for x in self.langs])) if self.langs else np.empty(0, "int64")
        self.rank = np.full((len(self.codes) + 1, len(self.langs)), -1, "int64")
        for k, lang in enumerate(self.langs):
            self.rank[np.searchsorted(self.codes, profiles[lang]), k] = np.arange(len(profiles[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        own = profile(text, self.size) if text and self.langs else np.empty(0, "int64")
        if not len(own):
            return UNKNOWN, 0.0
        at = np.searchsorted(self.codes, own)
        at[(at == len(self.codes)) | (self.codes[np.minimum(at, len(self.codes) - 1)] != own)] = len(self.codes)
        rank = self.rank[at]
        distance = np.where(rank >= 0, np.abs(rank - np.arange(len(own))[:, None]), self.size).sum(0)
        order = np.argsort(distance, kind="stable")
        least = float(distance[order[0]])
        second = float(distance[order[1]]) if len(order) > 1 else float(self.size * len(own))
        return self.langs[order[0]], (second - least) / second if second else 0.0


def predict_language(docs: DataFrame, profiles: dict[str, list[int]], keep: list[str], text_col: str = "text", size: int = PROFILE, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns ``keep`` with the language and the score, under ``names``. Nothing but the text is looked at."""
    if clash := {*names, "__text"} & {*keep}:
        raise ValueError(f"{sorted(clash)} are names of results: give them other names")
    picked = docs.select(*[F.col(x).alias(x) for x in keep], F.col(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = Ranks(profiles, size)
        for batch in slices(batches, "__text", SLICE_BYTES):
            found = [ranks.predict(x) for x in batch.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(x) for x in keep] + [pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], [*keep, *names])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in picked.schema.fields if f.name != "__text")
    return picked.mapInArrow(run, schema + f"`{names[0]}` string, `{names[1]}` double")
