"""Benchmark decontamination by winnowing, in DataFrame functions only.

A window is ``span`` consecutive words of a benchmark item, or the whole item where it has fewer. For each window length L that
the benchmark has, texts are fingerprinted with the least hash of the k-grams (k = min(gram, L)) among each L - k + 1 neighbours, so any
shared run of L words has a shared fingerprint. Documents whose fingerprints meet the benchmark's are read again; their windows
with such a fingerprint are the extended hits, compared word by word with the item windows.

NULL or wordless texts have no words, no hits and no items; wordless items have no window. Equal items each count. Rows are told apart
by id and text, so repeated rows each get their (equal) result and rows that share an id don't mix. An empty benchmark contaminates nothing.
Other columns of either table are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tileframe.llm.common import materialise

#: Words are runs of digits, ASCII letters (lowered) and anything beyond ASCII; all other ASCII characters become spaces.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BETWEEN = "".join(chr(c) for c in range(128) if not chr(c).isalnum() and c != 32)
#: Sides of at most so many rows are broadcast: fingerprints of 8 bytes, windows of about 100.
BROADCAST_PRINTS = 500_000
BROADCAST_WINDOWS = 50_000
BROADCAST_TOUCHED = 200_000


def words_of(text: Column) -> Column:
    plain = F.translate(F.coalesce(text, F.lit("")), UPPER + BETWEEN, UPPER.lower() + " " * len(BETWEEN))
    return F.array_remove(F.split(plain, " "), "")


def shifted(left: Column, right: Column, by: int, merge: Callable[[Column, Column], Column]) -> Column:
    """merge(left[i], right[i + by]) for each i that has both."""
    n = F.greatest(F.least(F.size(left), F.size(right) - by), F.lit(0))
    return F.zip_with(F.slice(left, F.lit(1), n), F.slice(right, F.lit(by + 1), n), merge)


def over_runs(df: DataFrame, col: str, width: int, merge: Callable[[Column, Column], Column]) -> DataFrame:
    """Replaces the list by one merged value for each ``width`` neighbours, by doubling. merge must be associative up to the choice of steps,
    which depend on the width alone."""
    powers = {1: col}
    have = 1
    while have * 2 <= width:
        df = df.withColumn(f"_{col}{have * 2}", shifted(F.col(powers[have]), F.col(powers[have]), have, merge))
        powers[have * 2] = f"_{col}{have * 2}"
        have *= 2
    done, name = have, powers[have]
    while done < width:
        step = max(x for x in powers if x <= width - done)
        df = df.withColumn(f"_{col}_{done + step}", shifted(F.col(name), F.col(powers[step]), done, merge))
        done, name = done + step, f"_{col}_{done + step}"
    made = [c for c in df.columns if c.startswith(f"_{col}") and c != name]
    return df.drop(*made) if name == col else df.drop(*made, col).withColumnRenamed(name, col)


def window_prints(df: DataFrame, span: int, gram: int, out: str) -> DataFrame:
    """Adds the winnowed fingerprint of each window of ``span`` words; df has ``words``."""
    k = min(gram, span)
    df = df.withColumn(out, F.transform("words", lambda w: F.xxhash64(w)))
    df = over_runs(df, out, k, lambda a, b: F.xxhash64(a, b))
    return over_runs(df, out, span - k + 1, lambda a, b: F.least(a, b))


def contaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", item_text_col: str = "text", span: int = 13, gram: int = 6) -> DataFrame:
    """doc_id, n_words, n_hit, item_ids (sorted as strings), text_hash: one row for each row of docs."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words_of(F.col(item_text_col)).alias("words")).where(F.size("words") > 0)
    items = items.withColumn("len", F.least(F.size("words"), F.lit(span)))
    starts = F.explode(F.sequence(F.lit(1), F.size("words") - F.col("len") + 1))
    windows = materialise(items.select("item", "len", "words", starts.alias("at")).select("item", "len", F.array_join(F.slice("words", F.col("at"), F.col("len")), " ").alias("window")).distinct(), "windows")
    lengths = [r.len for r in windows.select("len").distinct().collect()]  # at most ``span`` numbers
    sources = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("text_hash", F.xxhash64("text"))

    prints = []
    for length in lengths:
        own = windows.where(F.col("len") == length).select("window").distinct().select(F.split("window", " ").alias("words"))
        prints.append(window_prints(own, length, gram, "prints").select(F.explode_outer("prints").alias("print")))
    worded = sources.withColumn("words", words_of(F.col("text")))
    if not lengths:
        none = F.array().cast("array<string>")
        return worded.select("doc_id", F.size("words").cast("bigint").alias("n_words"), F.lit(0).cast("bigint").alias("n_hit"), none.alias("item_ids"), "text_hash")
    prints = materialise(reduce(DataFrame.unionByName, prints).where(F.col("print").isNotNull()).distinct(), "prints")
    side = F.broadcast(prints) if prints.count() <= BROADCAST_PRINTS else prints
    few = windows.count() <= BROADCAST_WINDOWS
    distinct = windows.select("len", "window").distinct()

    # One pass over the texts: which documents have a fingerprint of the benchmark. The first place is for the row itself, under a hash of
    # its own, so that rows without a hit are dealt out evenly too.
    def all_prints(df: DataFrame) -> DataFrame:
        for length in lengths:
            df = window_prints(df, length, gram, f"prints{length}")
        itself = F.array(F.xxhash64("doc_id", "text_hash"))
        return df.select("doc_id", "text_hash", "n_words", F.posexplode(F.concat(itself, *[F.array_distinct(f"prints{n}") for n in lengths])).alias("at", "print"))

    own = all_prints(worded.select("doc_id", "text_hash", "words", F.size("words").cast("bigint").alias("n_words")))
    itself = F.col("at") == 0
    own = own.join(side.withColumn("known", F.lit(1)), "print", "left").where(itself | F.col("known").isNotNull())
    found = own.groupBy("doc_id", "text_hash").agg(F.max("n_words").alias("n_words"), F.count_if(itself).alias("copies"), F.coalesce(F.max(F.when(~itself, F.col("known"))), F.lit(0)).alias("known"))
    found = materialise(found, "found")

    # Extend the hits: read the documents met again, and look at their windows that have a fingerprint met.
    touched = found.where("known = 1").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    touched = F.broadcast(touched) if touched.count() <= BROADCAST_TOUCHED else touched
    again = worded.join(touched, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))).select("doc_id", "text_hash", "words")
    again = materialise(again.dropDuplicates(["doc_id", "text_hash"]), "again")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    hits = []
    for length in lengths:
        seeds = window_prints(again, length, gram, "prints").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.posexplode_outer("prints").alias("at", "print"))
        seeds = seeds.join(side, "print").groupBy("_id", "_hash").agg(F.collect_list("at").alias("at"))
        own = again.join(seeds, same).withColumn("len", F.lit(length))
        texts = F.transform("at", lambda i: F.struct(i.alias("at"), F.array_join(F.slice("words", i + 1, length), " ").alias("window")))
        hits.append(own.select("doc_id", "text_hash", "len", F.explode_outer(texts).alias("w")).select("doc_id", "text_hash", "len", "w.at", "w.window"))
    hits = materialise(reduce(DataFrame.unionByName, hits).join(F.broadcast(distinct) if few else distinct, ["len", "window"]), "spans")
    spans = F.array_sort(F.collect_set(F.struct("at", (F.col("at") + F.col("len")).alias("end"))))
    per_doc = hits.groupBy("doc_id", "text_hash").agg(spans.alias("spans"))
    # Items are rows until they are a document's own: a window that many items share is met once a document, whatever its places.
    met = hits.select("doc_id", "text_hash", "len", "window").distinct().join(F.broadcast(windows) if few else windows, ["len", "window"]).select("doc_id", "text_hash", "item").distinct()
    met = met.groupBy(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_text")).agg(F.array_sort(F.collect_list("item")).alias("item_ids"))
    per_doc = per_doc.join(met, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_text")))
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("reach"))
    covered = F.aggregate("spans", start, lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["at"], s["reach"]))).cast("bigint").alias("n"), F.greatest(s["reach"], x["end"]).alias("reach")), lambda s: s["n"])
    per_doc = materialise(per_doc.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), covered.alias("n_hit"), "item_ids"), "hits")
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    joined = each.join(per_doc, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    return joined.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), "text_hash")
