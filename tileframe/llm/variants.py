"""Spelling variants: words of a vocabulary that differ by one letter, and the more frequent form that each goes to.

Near words are found with bit-sliced position indexes: for each position and letter a bitset of the words that have the letter
there. Two running sets go along the letters of a word, all words at once: those without an error so far, and those with one,
told apart into a replaced letter (same positions) and an inserted one (positions shifted by one). A deleted letter is an inserted one
seen from the other word, so each pair is found from its shorter side.

An index is over a bucket of the vocabulary, not over all of it. One error in a word of a letters lies in the first or the
second half, and the other half is the same in both words: buckets are the words of a or a + 1 letters that share such a half.
A bucket of more than BUCKET words has its half cut in two again, and so on down to one letter, where the alphabet bounds it; so
no bucket grows with the vocabulary and no pair is lost. A pair belongs to the bucket in whose window its first differing letter is, and
is given there alone.

Forms grow in frequency, so following them ends; roots are found by pointer doubling. NULL texts have no words, NULL ids count
as empty strings, repeated rows count again; an empty table gives an empty vocabulary. Other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tileframe.llm.common import materialise, release

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a bucket, beyond which it is cut further.
BUCKET = 1024
#: Buckets to be cut are broadcast up to this number.
BROADCAST_BUCKETS = 20_000


def lowered(word: Column) -> Column:
    """A-Z alone in lower case."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 5, min_count: int = 3, every: int | None = None) -> DataFrame:
    """word and n: letter runs of at least min_length letters that come up min_count times or more.

    every: a run loses one letter where this divides the crc32 of `<id>:<run>` (the letter at that crc32 modulo the length).
    """
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(RUN), F.lit(0))).alias("w"))
    words = runs.where(F.length("w") >= min_length).select("i", lowered(F.col("w")).alias("w"))
    if every:
        h = F.crc32(F.concat_ws(":", "i", "w").cast("binary"))
        words = words.select("w", h.alias("h"))
        at = (F.col("h") % F.length("w")).cast("int")
        cut = F.concat(F.substring(F.col("w"), F.lit(1), at), F.substring(F.col("w"), at + 2, F.length("w")))
        words = words.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("w")).alias("w")).where(F.length("w") >= min_length)
    return words.groupBy(F.col("w").alias("word")).agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def bucketed(rows: DataFrame) -> DataFrame:
    """key of each row: what is shared by the words of its bucket, outside the window from s to e of words of a letters."""
    rest = F.col("a") - F.col("e")
    return rows.withColumn("key", F.concat_ws(" ", "a", "s", F.substring(F.col("word"), F.lit(1), F.col("s")), F.substring(F.col("word"), F.length("word") - rest + 1, rest)))


def buckets(words: DataFrame, limit: int = BUCKET) -> DataFrame:
    """word, n, a, s, e and key: each word once for each bucket that it is in."""
    size = F.length("word")
    shorter = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("a")).where(F.col("a") > 0)
    half = F.floor(F.col("a") / 2).cast("int")
    rows = shorter.select("word", "n", "a", F.explode(F.array(F.struct(F.lit(0).alias("s"), half.alias("e")), F.struct(half.alias("s"), F.col("a").alias("e")))).alias("x")).select("word", "n", "a", "x.s", "x.e")
    rows = materialise(bucketed(rows.where(F.col("e") > F.col("s"))), "buckets")
    done = None
    while True:
        large = materialise(rows.where(F.col("e") - F.col("s") > 1).groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > limit).select("key"), "large-buckets")
        n = large.count()
        if not n:
            return rows if done is None else done.unionByName(rows)
        large = F.broadcast(large) if n <= BROADCAST_BUCKETS else large
        small = rows.join(large, "key", "left_anti")
        done = small if done is None else done.unionByName(small)
        middle = F.floor((F.col("s") + F.col("e")) / 2).cast("int")
        halves = F.array(F.struct("s", middle.alias("e")), F.struct(middle.alias("s"), "e"))
        again = rows.join(large, "key", "left_semi").select("word", "n", "a", F.explode(halves).alias("x")).select("word", "n", "a", "x.s", "x.e")
        rows = materialise(bucketed(again), "buckets")


def common_prefix(v: str, w: str) -> int:
    n = 0
    for a, b in zip(v, w, strict=False):
        if a != b:
            break
        n += 1
    return n


def one_error(words: list[str], a: int) -> Iterator[tuple[int, int]]:
    """Pairs of places in words: one of a letters, and one of as many or one more, that differ by exactly one letter."""
    having: dict[tuple[int, str], int] = defaultdict(int)
    same = longer = 0
    for i, w in enumerate(words):
        bit = 1 << i
        for p, c in enumerate(w):
            having[p, c] |= bit
        if len(w) == a:
            same |= bit
        else:
            longer |= bit
    for i, w in enumerate(words):
        if len(w) != a:
            continue
        exact = grown = same | longer
        replaced = 0
        for p, c in enumerate(w):
            here = having[p, c]
            replaced = replaced & here | exact & ~here
            exact &= here
            grown = grown & having.get((p + 1, c), 0) | exact
        found = replaced & same | grown & longer
        while found:
            low = found & -found
            yield i, low.bit_length() - 1
            found ^= low


def near_words(words: DataFrame, limit: int = BUCKET) -> DataFrame:
    """word, near and near_n: each pair of words at one inserted, deleted or replaced letter, once in either direction."""
    rows = buckets(words, limit).select("key", "a", "s", "e", "word", "n").repartition("key").sortWithinPartitions("key")
    schema = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])

    def pairs(group: list[tuple]) -> Iterator[tuple[str, str, int]]:
        _, a, s, e, _, _ = group[0]
        names, counts = [r[4] for r in group], [r[5] for r in group]
        for i, j in one_error(names, a):
            v, w = names[i], names[j]
            if len(w) == a:
                yield v, w, counts[j]
            elif s <= (p := common_prefix(v, w)) < e or p == e == a:
                yield v, w, counts[j]
                yield w, v, counts[i]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        out: list[tuple[str, str, int]] = []

        def packed() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[], [], []]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if group and row[0] != group[0][0]:
                    if len(group) > 1:
                        out += pairs(group)
                    group = []
                group.append(row)
            if len(out) > 50_000:
                yield packed()
            release()
        if len(group) > 1:
            out += pairs(group)
        yield packed()

    return rows.mapInArrow(run, "word string, near string, near_n bigint")


def roots(forms: DataFrame, max_rounds: int = 40) -> DataFrame:
    """word and root for rows of word and form: the last word when forms are followed."""
    now = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(max_rounds):
        further = now.select(F.col("word").alias("at"), F.col("root").alias("next"))
        step = materialise(now.join(further, F.col("root") == F.col("at"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = step.select("word", "root")
        if step.where("moved").isEmpty():
            return now
    raise RuntimeError(f"forms do not end after {max_rounds} rounds; do counts grow along them?")


def spelling_variants(words: DataFrame, ratio: int = 2, limit: int = BUCKET) -> DataFrame:
    """word, form, root, n, n_near and form_n for each row of word and n (words distinct).

    form: the near word of largest n (ties: smallest in code-point order) if that n is at least ratio times the word's, else NULL;
    root: where forms lead, the word itself if it has none.
    """
    words = materialise(words.select("word", F.col("n").cast("bigint").alias("n")), "words")
    best = near_words(words, limit).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w"))).alias("best"))
    known = words.join(best, "word", "left")
    taken = -F.col("best.m") >= ratio * F.col("n")
    known = known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(taken, F.col("best.w")).alias("form"), F.when(taken, -F.col("best.m")).alias("form_n"))
    known = materialise(known, "forms")
    return known.join(roots(known.where(F.col("form").isNotNull())), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
