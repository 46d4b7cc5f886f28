"""Language-model scores with stupid backoff over the n-grams of all documents, n = 1 to 3.

Tokens are ids of a public word vocabulary (its path is a parameter), so an n-gram is one exact integer. Documents are encoded once and kept
as batches of token ids. Each batch's distinct bigrams and trigrams with their counts are dealt by hash into buckets; a bucket adds
up the counts of all batches (its part of the count tables) and gives each batch the totals of its own n-grams, in their order.
A batch then looks up each position's n-grams in its totals and sums the logs for each document. Since a batch sends an n-gram
once, however often it has it, no n-gram weighs more in a bucket than there are batches. Unigram counts are a table bounded by the vocabulary.

A document is scored by the other rows: its own counts are taken off every count (``leave_out``; copies in other rows stay). For a token c
after a and b the score is count(abc) / count(ab) if count(abc) > 0, else alpha * count(bc) / count(b) if count(bc) > 0, else
alpha^2 * max(1, count(c)) / max(1, count of all tokens). The second token starts at its bigram and the first at its unigram, without an
alpha for the missing words. log_score is the sum of the natural logs over the document's tokens, lm_score their mean.

NULL and empty texts have n_scored 0, log_score and lm_score NULL. Rows are told apart, so a text that is there twice is scored
by its copy; rows that share an id keep a result each. An empty table gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tileframe.llm.common import materialise, slices
from tileframe.llm.tokens import GROUP_BYTES, load_tokenizer, worker_pieces

#: A batch is closed when it has so many tokens or documents (a longer document makes a larger one).
BATCH_TOKENS = 1_000_000
BATCH_DOCS = 200_000
#: Distinct n-grams of all batches that a bucket should get, about.
BUCKET_GRAMS = 1_500_000


def pack(x: np.ndarray) -> bytes:
    """An array of integers, byte by byte of their size, under zstd: high bytes are nearly always 0."""
    return pa.compress(np.ascontiguousarray(x.view("uint8").reshape(len(x), -1).T).tobytes(), codec="zstd", asbytes=True) if len(x) else b""


def unpack(data: bytes, n: int, kind: str) -> np.ndarray:
    if not n:
        return np.empty(0, kind)
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, n * width, codec="zstd"), "uint8").reshape(width, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def in_order(keys: np.ndarray, largest: int) -> np.ndarray:
    """The places of keys (0 to largest) in ascending order, equal keys by place: one sort of plain integers where both fit."""
    bits = max(1, len(keys)).bit_length()
    if largest.bit_length() + bits > 63:
        return np.argsort(keys, kind="stable")
    packed = keys << bits
    packed |= np.arange(len(keys))
    packed.sort()
    packed &= (1 << bits) - 1
    return packed.astype("int32") if bits < 32 else packed


class Grams:
    """The n-grams of one order of a batch: for each place that has one, its rank among the distinct ones."""

    def __init__(self, keys: np.ndarray, largest: int):
        self.order = in_order(keys, largest)
        ordered = keys[self.order]
        self.first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(keys) else np.empty(0, "int64")
        self.counts = np.diff(np.append(self.first, len(keys)))
        self.rank = np.empty(len(keys), self.order.dtype)
        self.rank[self.order] = np.repeat(np.arange(len(self.first), dtype=self.order.dtype), self.counts)

    def own(self, doc: np.ndarray) -> np.ndarray:
        """How often each place's n-gram is in its own document; documents lie one after the other."""
        doc, rank = doc[self.order], self.rank[self.order]
        start = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (rank[1:] != rank[:-1])])) if len(doc) else np.empty(0, "int64")
        times = np.diff(np.append(start, len(doc)))
        out = np.empty(len(doc), self.order.dtype)
        out[self.order] = np.repeat(times.astype(out.dtype), times)
        return out


class Batch:
    """Tokens of consecutive documents. Bigrams and trigrams are named by the place of their last token."""

    def __init__(self, tokens: np.ndarray, lengths: np.ndarray, size: int):
        self.tokens, self.lengths, self.size = tokens, lengths, size
        small = "int32" if len(tokens) < 1 << 31 else "int64"
        self.doc = np.repeat(np.arange(len(lengths), dtype=small), lengths)
        since = np.arange(len(tokens), dtype=small) - np.repeat((np.cumsum(lengths) - lengths).astype(small), lengths)
        self.at2, self.at3 = np.flatnonzero(since >= 1).astype(small), np.flatnonzero(since >= 2).astype(small)
        self.two = Grams(self.pairs(self.at2), size * size)
        # Pairs by their rank, so that a trigram fits beside its place in one integer.
        place = np.zeros(len(tokens), "int64")
        place[self.at2] = self.two.rank
        self.three = Grams(place[self.at3 - 1] * size + self.tokens[self.at3], max(1, len(self.two.first)) * size)

    def pairs(self, at: np.ndarray) -> np.ndarray:
        return self.tokens[at - 1].astype("int64") * self.size + self.tokens[at]

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct bigrams (as -1 - key), then trigrams, with their counts."""
        two, at = self.two, self.at3[self.three.order[self.three.first]]
        pairs = self.pairs(self.at2[two.order[two.first]])
        three = self.pairs(at - 1) * self.size + self.tokens[at]
        return np.concatenate([-1 - pairs, three]), np.concatenate([two.counts, self.three.counts])

    def scores(self, totals: np.ndarray, unigrams: np.ndarray, alpha: float, leave_out: bool) -> np.ndarray:
        """The log score of each token; totals are those of keys()."""
        own = (lambda grams, doc: grams.own(doc)) if leave_out else (lambda grams, doc: 0)
        count1 = unigrams[self.tokens] - own(Grams(self.tokens.astype("int64"), self.size), self.doc)
        n2 = len(self.two.first)
        count2 = np.zeros(len(self.tokens), "int64")
        count2[self.at2] = totals[:n2][self.two.rank] - own(self.two, self.doc[self.at2])
        count3 = np.zeros(len(self.tokens), "int64")
        count3[self.at3] = totals[n2:][self.three.rank] - own(self.three, self.doc[self.at3])
        everything = unigrams.sum() - (self.lengths[self.doc] if leave_out else 0)
        log = np.log(np.maximum(count1, 1) / np.maximum(everything, 1))
        log[self.at2] += np.log(alpha)
        log[self.at3] += np.log(alpha)
        seen2 = self.at2[count2[self.at2] > 0]
        # The second token of a document starts at its bigram; later ones have backed off to it.
        log[seen2] = np.log(count2[seen2] / count1[seen2 - 1])
        is3 = np.zeros(len(self.tokens), bool)
        is3[self.at3] = True
        log[seen2] += np.where(is3[seen2], np.log(alpha), 0.0)
        seen3 = self.at3[count3[self.at3] > 0]
        log[seen3] = np.log(count3[seen3] / count2[seen3 - 1])
        return log


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    x = keys.astype("uint64") * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(buckets)).astype("int64")


def dealt(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of keys by bucket, and how many each bucket has."""
    bucket = bucket_of(keys, buckets)
    return in_order(bucket, buckets), np.bincount(bucket, minlength=buckets)


def batches_of(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str) -> DataFrame:
    """batch, ids (of its documents, in order), lengths and tokens (packed, 2 or 4 bytes each)."""
    kind = docs.schema[id_col].dataType.simpleString()
    wide = load_tokenizer(tokenizer_path).get_vocab_size() > 1 << 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pieces, number = worker_pieces(tokenizer_path, False), TaskContext.get().partitionId() << 24
        held: list[tuple] = []

        def closed() -> pa.RecordBatch:
            ids = pa.concat_arrays([x for x, _, _ in held])
            lengths = np.concatenate([x for _, x, _ in held]).astype("int32")
            flat = np.concatenate([x for _, _, x in held])
            whole = pa.array([0, len(ids)], pa.int32())
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.ListArray.from_arrays(whole, ids), pa.ListArray.from_arrays(whole, pa.array(lengths)), pa.array([pack(flat)], pa.binary())], ["batch", "ids", "lengths", "tokens"])

        for part in slices(batches, "text", GROUP_BYTES // 4):
            found = pieces.texts(part.column("text"))
            held.append((part.column("doc_id"), found.lengths, found.flat.astype("<u4" if wide else "<u2")))
            if sum(len(x) for _, _, x in held) >= BATCH_TOKENS or sum(len(x) for _, x, _ in held) >= BATCH_DOCS:
                yield closed()
                number += 1
                held.clear()
        if held:
            yield closed()

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"batch bigint, ids array<{kind}>, lengths array<int>, tokens binary")


def lm_scores(docs: DataFrame, tokenizer_path: str, alpha: float = 0.4, leave_out: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_scored, log_score and lm_score for each row of docs."""
    spark = docs.sparkSession
    size = load_tokenizer(tokenizer_path).get_vocab_size()
    if size**3 >= 1 << 63:
        raise ValueError("a trigram of this vocabulary doesn't fit in 63 bits")
    width = "<u4" if size > 1 << 16 else "<u2"
    kept = materialise(batches_of(docs, tokenizer_path, id_col, text_col), "batches")

    def one(batch: pa.RecordBatch, row: int) -> Batch:
        lengths = batch.column("lengths")[row].values.to_numpy().astype("int64")
        return Batch(unpack(batch.column("tokens")[row].as_py(), int(lengths.sum()), width), lengths, size)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, "int64")
        for batch in batches:
            for row in range(batch.num_rows):
                n = pc.sum(batch.column("lengths")[row].values).as_py()
                total += np.bincount(unpack(batch.column("tokens")[row].as_py(), n or 0, width), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["token", "n"])

    # At most as many rows as the vocabulary has.
    unigrams = np.zeros(size, "int64")
    for row in kept.select("lengths", "tokens").mapInArrow(count, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).collect():
        unigrams[row.token] = row.n
    known = spark.sparkContext.broadcast(unigrams)
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), int(unigrams.sum()) // (3 * BUCKET_GRAMS))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                keys, n = one(batch, row).keys()
                place, sizes = dealt(keys, buckets)
                stops = np.cumsum(sizes)
                some = np.flatnonzero(sizes)
                runs = [(keys[place[stop - k : stop]], n[place[stop - k : stop]]) for stop, k in zip(stops[some].tolist(), sizes[some].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(some), batch.column("batch")[row].as_py())), pa.array(some.astype("int32")), pa.array(sizes[some]),
                        pa.array([pack(np.diff(x, prepend=0)) for x, _ in runs], pa.binary()), pa.array([pack(x) for _, x in runs], pa.binary()),
                    ],
                    ["batch", "bucket", "size", "keys", "n"],
                )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All rows of some buckets: the counts of each n-gram over all batches, for each row in its own order."""
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        sizes = [b.column("size").to_pylist() for b in held]
        keys = np.concatenate([np.cumsum(unpack(x.as_py(), k, "int64")) for b, s in zip(held, sizes, strict=True) for x, k in zip(b.column("keys"), s, strict=True)])
        n = np.concatenate([unpack(x.as_py(), k, "int64") for b, s in zip(held, sizes, strict=True) for x, k in zip(b.column("n"), s, strict=True)])
        order = np.argsort(keys)
        ordered = keys[order]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        others = np.repeat(np.add.reduceat(n[order], first), np.diff(np.append(first, len(keys))))
        more = np.empty(len(keys), "int64")
        more[order] = others
        more -= n
        at = 0
        for b, s in zip(held, sizes, strict=True):
            mine = []
            for k in s:
                mine.append(pack(more[at : at + k]))
                at += k
            yield pa.RecordBatch.from_arrays([b.column("batch"), b.column("bucket"), b.column("size"), pa.array(mine, pa.binary())], ["batch", "bucket", "size", "more"])

    sent = kept.select("batch", "lengths", "tokens").mapInArrow(send, "batch bigint, bucket int, size bigint, keys binary, n binary")
    # How often the other batches have each n-gram.
    totals = sent.repartitionById(buckets, F.col("bucket")).mapInArrow(add, "batch bigint, bucket int, size bigint, more binary")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.combine_chunks()
        rows = left.to_batches()[0]
        batch = one(rows, 0)
        ids, lengths = rows.column("ids")[0].values, batch.lengths
        keys, own = batch.keys()
        place, _ = dealt(keys, buckets)
        right = right.sort_by("bucket")
        if len(keys):
            own[place] += np.concatenate([unpack(x.as_py(), k.as_py(), "int64") for x, k in zip(right.column("more"), right.column("size"), strict=True)])
        log = batch.scores(own, known.value, alpha, leave_out)
        sums = np.bincount(batch.doc, log, len(lengths)).astype("float64")
        some = lengths > 0
        mean = sums / np.maximum(lengths, 1)
        return pa.table([ids, pa.array(lengths), pa.array(sums, mask=~some), pa.array(mean, mask=~some)], names=["doc_id", "n_scored", "log_score", "lm_score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return kept.groupBy("batch").cogroup(totals.groupBy("batch")).applyInArrow(score, f"doc_id {kind}, n_scored bigint, log_score double, lm_score double")


def positions(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str) -> DataFrame:
    """One row for each distinct position of a row of docs: its last three tokens as keys, how often the row has it (n), and how often the row has each part.

    row and doc_id tell the row; n_tokens is its length (a row without tokens has one position with n 0).
    """
    size = load_tokenizer(tokenizer_path).get_vocab_size()
    kind = docs.schema[id_col].dataType.simpleString()
    fields = ["n", "k3", "ka", "kb", "b", "c", "own3", "own_a", "own_b2", "own_b", "own_c"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pieces, row = worker_pieces(tokenizer_path, False), TaskContext.get().partitionId() << 40
        for part in slices(batches, "text", GROUP_BYTES // 4):
            found = pieces.texts(part.column("text"))
            lengths, tokens = found.lengths.astype("int64"), found.flat.astype("int64")
            batch = Batch(tokens, lengths, size)
            grams1 = Grams(tokens, size)
            own1, doc = grams1.own(batch.doc), batch.doc.astype("int64")
            own2, own3 = np.zeros(len(tokens), "int64"), np.zeros(len(tokens), "int64")
            own2[batch.at2], own3[batch.at3] = batch.two.own(batch.doc[batch.at2]), batch.three.own(batch.doc[batch.at3])
            pair, triple = np.full(len(tokens), -1), np.full(len(tokens), -1)
            pair[batch.at2] = batch.pairs(batch.at2)
            triple[batch.at3] = pair[batch.at3 - 1] * size + tokens[batch.at3]
            before = np.arange(len(tokens)) - 1
            first = np.ones(len(tokens), bool)
            first[batch.at2] = False
            shift = lambda values, none: np.where(first, none, values[np.maximum(before, 0)]) if len(values) else values
            table = np.stack([doc, triple, shift(pair, -1), pair, shift(tokens, -1), tokens, own3, shift(own2, 0), own2, shift(own1, 0), own1], 1)
            rows, n = np.unique(table, axis=0, return_counts=True) if len(table) else (table, np.empty(0, "int64"))
            none = np.flatnonzero(lengths == 0)
            at = np.concatenate([rows[:, 0], none])
            columns = [np.concatenate([x, np.zeros(len(none), "int64")]) for x in (n, *rows[:, 1:].T)]
            yield pa.RecordBatch.from_arrays([pa.array(row + at), part.column("doc_id").take(pa.array(at)), pa.array(lengths[at]), *map(pa.array, columns)], ["row", "doc_id", "n_tokens", *fields])
            row += len(lengths)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"row bigint, doc_id {kind}, n_tokens bigint, " + ", ".join(f"{f} bigint" for f in fields))


def lm_scores_by_joins(docs: DataFrame, tokenizer_path: str, alpha: float = 0.4, leave_out: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What ``lm_scores`` gives, by relations: count tables of n-grams dealt by hash, joined to the exploded n-grams, summed for each document.

    Counts are summed before they are shuffled; but each document's distinct n-grams are rows that three joins deal out. Count tables of any
    corpus can be joined this way.
    """
    grams = positions(docs, tokenizer_path, id_col, text_col)
    real = grams.where("n > 0")
    total = lambda key: real.where(F.col(key) >= 0).groupBy(F.col(key).alias("_key")).agg(F.sum("n").alias("_n"))
    three, two, one = total("k3"), total("kb"), materialise(total("c"), "unigrams")  # the last has at most a row a word of the vocabulary
    every = one.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]

    def met(df: DataFrame, counts: DataFrame, key: str, own: str, name: str) -> DataFrame:
        side = counts.select(F.col("_key").alias(f"_{name}"), F.col("_n").alias(name))
        left = F.coalesce(F.col(name), F.lit(0)) - (F.col(own) if leave_out else F.lit(0))
        return df.join(side, F.col(key) == F.col(f"_{name}"), "left").withColumn(name, left).drop(f"_{name}")

    g = grams
    for counts, key, own, name in ((three, "k3", "own3", "abc"), (two, "ka", "own_a", "ab"), (two, "kb", "own_b2", "bc"), (F.broadcast(one), "b", "own_b", "cb"), (F.broadcast(one), "c", "own_c", "cc")):
        g = met(g, counts, key, own, name)
    a, rest = F.lit(float(alpha)), F.lit(every) - (F.col("n_tokens") if leave_out else F.lit(0))
    unigram = F.log(F.greatest("cc", F.lit(1)) / F.greatest(rest, F.lit(1)))
    log = F.when(F.col("kb") < 0, unigram).when(F.col("k3") < 0, F.when(F.col("bc") > 0, F.log(F.col("bc") / F.col("cb"))).otherwise(F.log(a) + unigram))
    log = log.when(F.col("abc") > 0, F.log(F.col("abc") / F.col("ab"))).when(F.col("bc") > 0, F.log(a) + F.log(F.col("bc") / F.col("cb"))).otherwise(2 * F.log(a) + unigram)
    sums = g.groupBy("row", "doc_id", "n_tokens").agg(F.sum(F.when(F.col("n") > 0, F.col("n") * log)).alias("log_score"))
    return sums.select("doc_id", F.col("n_tokens").alias("n_scored"), "log_score", (F.col("log_score") / F.col("n_tokens")).alias("lm_score"))
