"""Toxicity scores: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is a run of characters between ASCII white space, lower-cased, without leading and trailing punctuation. Its vector is the mean of
the vectors of its hashed character n-grams (3 to 5, word ends marked) and of the word itself; a document's is the mean over
its words. Both the vectors and the softmax on top are learned. An unseen misspelling shares most n-grams with the words it
comes from. As the model is linear after the mean, a worker remembers one number per distinct word.

The model is fitted on a bounded sample of labelled rows (``max_rows`` ids, chosen by hash, and one text of each); of these only bags of
words come to the driver, as numbers, with each distinct word once. Every text is scored whole. NULL texts, texts without words,
and all texts when there is no labelled row of either class get the prior alone. An id that is labelled twice has the larger label, an id
with several texts teaches the one of least hash; NULL ids and labels teach nothing; equal rows teach once and are each scored. An empty
table gives no rows. Columns of the input are carried only if asked for (``keep``), which may not hold the names of the results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tileframe.llm.common import materialise, mix, release, slices
from tileframe.llm.ragged import Lists, Memory

BUCKETS = 1 << 17
PUNCTUATION = ".,;:!?\"'()[]{}<>-_*"
SLICE_BYTES = 2 << 20
#: Entries of a sparse matrix, and words, that are gone through at a time.
PIECE = 1 << 18
#: The multiplier of the n-gram hash, a polynomial over code points.
STEP = np.uint64(0x100000001B3)


def clean(piece: str) -> str:
    """The word of a piece without white space; empty if there is none."""
    return piece.lower().strip(PUNCTUATION)


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For the n-grams of all words: the place of the word, and the bucket."""
    points = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), "<u4").astype("uint64")
    sizes = np.fromiter(map(len, words), "int64", len(words)) + 2
    ends, owner = np.cumsum(sizes), np.repeat(np.arange(len(words)), sizes)
    left = ends[owner] - np.arange(len(points))
    powers = np.cumprod(np.concatenate([np.ones(1, "uint64"), np.full(int(sizes.max(initial=1)), STEP)]))
    owners, codes = [np.arange(len(words))], [np.add.reduceat(points * powers[left - 1], ends - sizes) if len(words) else points]
    code = np.zeros(len(points), "uint64")
    for n in (1, 2, 3, 4, 5):
        code = code[: max(0, len(points) - n + 1)] * STEP + points[n - 1 :]
        if n > 2:
            whole = left[: len(code)] >= n
            owners.append(owner[: len(code)][whole])
            codes.append(code[whole] + np.uint64(n << 56))
    return np.concatenate(owners), (mix(np.concatenate(codes)) % np.uint64(BUCKETS)).astype("int64")


@dataclass
class Model:
    """score of a word: w . vector(word), as one number per subword; of a text: sigmoid(bias + mean)."""

    subword: np.ndarray
    bias: float

    def words(self, words: list[str]) -> np.ndarray:
        owner, bucket = subwords(words)
        return np.bincount(owner, self.subword[bucket], len(words)) / np.maximum(1, np.bincount(owner, minlength=len(words)))


class Rows:
    """A sparse matrix by rows (none empty), with its product and transposed product; weights None: entries of a row are averaged.

    Both products go through the entries a piece at a time, so that they hold little more than their results.
    """

    def __init__(self, lengths: np.ndarray, columns: np.ndarray, weights: np.ndarray | None, n_columns: int):
        self.n, self.n_columns, self.columns = len(lengths), n_columns, columns.astype("int32", copy=False)
        self.share = np.ones(self.n, "float32") if weights is not None else (1 / lengths).astype("float32")
        self.weights = None if weights is None else weights.astype("float32", copy=False)
        self.starts = np.append(0, np.cumsum(lengths))
        # Columns and places in one number each, sorted where they are: a stable order without its working space.
        order = self.columns.astype("int64")
        order <<= 32
        for at in range(0, len(order), PIECE):
            order[at : at + PIECE] |= np.arange(at, min(at + PIECE, len(order)))
        order.sort()
        new = np.ones(len(order), bool)
        for at in range(1, len(order), PIECE):
            new[at : at + PIECE] = (order[at : at + PIECE] ^ order[at - 1 : at - 1 + PIECE][: len(order) - at]) >> 32 != 0
        self.used = (order[new] >> 32).astype("int32")
        self.back_starts = np.append(np.flatnonzero(new), len(columns))
        del new
        order &= 0xFFFFFFFF
        self.back_weights = None if weights is None else self.weights[order]
        self.back_rows = np.repeat(np.arange(self.n, dtype="int32"), lengths)[order]

    @staticmethod
    def sums(x: np.ndarray, at: np.ndarray, weights: np.ndarray | None, starts: np.ndarray) -> np.ndarray:
        """The sum of x[at] * weights from each start to the next."""
        out, low = np.empty((len(starts) - 1, x.shape[1]), x.dtype), 0
        while low < len(out):
            high = max(low + 1, int(np.searchsorted(starts, starts[low] + PIECE, "right")) - 1)
            some = slice(starts[low], starts[high])
            values = x[at[some]]
            if weights is not None:
                values *= weights[some, None]
            out[low:high] = np.add.reduceat(values, starts[low:high] - starts[low], axis=0)
            low = high
        return out

    def times(self, x: np.ndarray) -> np.ndarray:
        return self.sums(x, self.columns, self.weights, self.starts) * self.share[:, None].astype(x.dtype)

    def back(self, g: np.ndarray) -> np.ndarray:
        """Of the used columns only."""
        return self.sums(g * self.share[:, None].astype(g.dtype), self.back_rows, self.back_weights, self.back_starts)


def gradients(docs: Rows, bag_of: Rows, labels: np.ndarray, table: np.ndarray, top: np.ndarray, bias: np.ndarray, scale: float) -> tuple[float, list[np.ndarray]]:
    """The mean log loss, and its gradients by the used rows of the table, by the softmax weights and by the bias."""
    mean = docs.times(bag_of.times(table)) * scale
    logit = np.clip((mean @ top)[:, 0] + bias, -30, 30)
    loss = float(np.mean(np.log1p(np.exp(-logit)) + (1 - labels) * logit))
    wrong = ((1 / (1 + np.exp(-logit)) - labels) / len(labels))[:, None].astype(table.dtype)
    to_words = np.zeros((bag_of.n, table.shape[1]), table.dtype)
    to_words[docs.used] = docs.back(wrong @ top.T * scale)
    return loss, [bag_of.back(to_words), mean.T @ wrong, wrong.sum(0)]


def fit(labels: np.ndarray, lengths: np.ndarray, text: np.ndarray, word: np.ndarray, n: np.ndarray, words: list[str], dim: int = 4, epochs: int = 60, rate: float = 0.05, scale: float = 40.0, decay: float = 2e-5, seed: int = 7) -> Model:
    """Adam over the whole sample at each step; logits are softmax differences of the two classes.

    Each text has a label and its number of words; text and word (places in ``labels`` and ``words``) and n are the bags, by text.
    """
    positive = float(labels.sum())
    prior = math.log((positive + 0.5) / (len(labels) - positive + 0.5)) if len(labels) else math.log(0.05)
    texts, starts = np.unique(text, return_index=True)
    labels = labels[texts].astype("float32")
    if not len(labels) or labels.min() == labels.max():
        return Model(np.zeros(BUCKETS, "float32"), prior)
    docs = Rows(np.diff(np.append(starts, len(text))), word, n / lengths[text], len(words))
    some = []
    for at in range(0, len(words), PIECE // 16):
        owner, bucket = subwords(words[at : at + PIECE // 16])
        some.append((np.bincount(owner), bucket[np.argsort(owner, kind="stable")].astype("int32")))
    sizes, buckets = np.concatenate([x for x, _ in some]), np.concatenate([x for _, x in some])
    del some
    bag_of = Rows(sizes, buckets, None, BUCKETS)
    del sizes, buckets
    random = np.random.default_rng(seed)
    table = (random.normal(0, 0.1, (BUCKETS, dim))).astype("float32")
    top, bias = random.normal(0, 0.5, (dim, 1)).astype("float32"), np.array([prior], "float32")
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (table[bag_of.used], top, bias)]
    used = table[bag_of.used]
    for step in range(1, epochs + 1):
        table[bag_of.used] = used
        _, grads = gradients(docs, bag_of, labels, table, top, bias, scale)
        grads[0] += decay * used
        grads[1] += 1e-5 * top
        for k, (x, g) in enumerate(zip((used, top, bias), grads, strict=True)):
            m, v = moments[k]
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    table[bag_of.used] = used
    seen = np.zeros(BUCKETS, bool)
    seen[bag_of.used] = True
    return Model(np.where(seen, (table @ top)[:, 0] * scale, 0).astype("float32"), float(bias[0]))


def bags_of(docs: DataFrame) -> DataFrame:
    """Of columns row, y and text: row, y, n_words, word, n, a row for each distinct word; texts without words have one with a NULL word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            pieces, owner = split(batch.column("text"))
            coded = pieces.dictionary_encode()
            words = pa.array([clean(x) for x in coded.dictionary.to_pylist()], pa.string()).dictionary_encode()
            found = words.indices.to_numpy()[coded.indices.to_numpy()] if len(pieces) else np.empty(0, "int64")
            real = pc.binary_length(words.dictionary).to_numpy()[found] > 0 if len(found) else np.empty(0, bool)
            pair, n = np.unique(owner[real].astype("int64") << 32 | found[real], return_counts=True)
            n_words = np.bincount(owner[real], minlength=batch.num_rows)
            none = np.flatnonzero(n_words == 0)
            rows = np.concatenate([pair >> 32, none])
            word = pa.concat_arrays([words.dictionary.take(pa.array(pair & 0xFFFFFFFF)), pa.nulls(len(none), pa.string())])
            yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(rows)), batch.column("y").take(pa.array(rows)), pa.array(n_words[rows]), word, pa.array(np.concatenate([n, np.zeros(len(none), n.dtype)]))], ["row", "y", "n_words", "word", "n"])

    return docs.select("row", "y", "text").mapInArrow(run, "row bigint, y int, n_words bigint, word string, n bigint")


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The pieces between ASCII white space (some may be empty), and the place of each one's text."""
    cut = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
    return cut.flatten(), np.repeat(np.arange(len(texts)), pc.list_value_length(cut).to_numpy())


def sampled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_rows: int) -> DataFrame:
    """row, y and text of at most max_rows labelled ids, the ones of least hash, with one text each (equal rows are not told apart yet)."""
    labelled = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    held = docs.select(F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__hash")).join(labelled, "__id").groupBy("__id").agg(F.min("__hash").alias("__hash"), F.first("y").alias("y"))
    chosen = materialise(held.orderBy(F.xxhash64(F.lit("toxicity"), "__id"), "__id").limit(max_rows), "sample")
    # At most max_rows ids, hashes and labels: a bounded table.
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("__hash")).join(F.broadcast(chosen), ["__id", "__hash"])
    return texts.select(F.xxhash64("__id", "__hash").alias("row"), "y", "text")


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 6000) -> Model:
    """Fit on at most ``max_rows`` labelled documents (the caller filters held-out ids from ``labels``)."""
    bags = bags_of(sampled(docs, labels, id_col, text_col, label_col, max_rows)).dropDuplicates(["row", "word"]).withColumn("key", F.xxhash64("word"))
    bags = materialise(bags, "bags")
    texts = bags.groupBy("row").agg(F.first("y").alias("y"), F.first("n_words").alias("n_words")).orderBy("row").toArrow()
    row, y, n_words = (texts.column(x).to_numpy() for x in ("row", "y", "n_words"))
    # Each distinct word once, then at most max_rows bags of numbers.
    named = bags.where("word is not null").groupBy("word", "key").agg(F.lit(1)).select("word", "key").orderBy("word").toArrow()
    words, keys = named.column("word").to_pylist(), named.column("key").to_numpy()
    del named
    held = bags.where("word is not null").select("row", "key", F.col("n").cast("int").alias("n")).toArrow()
    order = np.argsort(keys, kind="stable")
    word = order[np.searchsorted(keys[order], held.column("key").to_numpy())].astype("int32")
    text, n = np.searchsorted(row, held.column("row").to_numpy()).astype("int32"), held.column("n").to_numpy()
    del held
    order = np.lexsort([word, text])
    text, word, n = text[order], word[order], n[order]
    del order, keys
    release()
    return fit(y, n_words, text, word, n, words)


def score_toxicity(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text", name: str = "score") -> DataFrame:
    """The columns ``keep`` with the score, from 0 to 1, under ``name``. Nothing but the text is looked at."""
    if clash := {name, "__text"} & {*keep}:
        raise ValueError(f"{sorted(clash)} are names of results: give them other names")
    picked = docs.select(*[F.col(x).alias(x) for x in keep], F.col(text_col).alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value

        def encode(pieces: pa.Array) -> Lists:
            words = [clean(x) for x in pieces.to_pylist()]
            real = np.array([bool(x) for x in words], bool)
            return Lists(real.astype("int64"), model.words([x for x in words if x]))

        known = Memory(encode, Lists(np.empty(0, "int64"), np.empty(0)))
        for batch in slices(batches, "__text", SLICE_BYTES):
            pieces, owner = split(batch.column("__text"))
            coded = pieces.dictionary_encode()
            found = known.get(coded.dictionary).take(coded.indices.to_numpy())
            n = np.bincount(owner, found.lengths, batch.num_rows)
            logit = model.bias + np.bincount(np.repeat(owner, found.lengths), found.flat, batch.num_rows) / np.maximum(1, n)
            out = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(x) for x in keep] + [pa.array(out)], [*keep, name])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in picked.schema.fields if f.name != "__text")
    return picked.mapInArrow(run, schema + f"`{name}` double")
