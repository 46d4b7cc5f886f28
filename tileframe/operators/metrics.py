"""Counting and metrics. Sufficient statistics are confusion counts in long form (keys, true_id, pred_id, n), always dense.

An undefined ratio is NULL by default, 0 with undefined="zero", and n / (d + 1e-8) with undefined="eps".
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tileframe.functions import pct, is_close

EPS = 1e-8


def ratio(n: Column, d: Column, undefined: str = "null") -> Column:
    if undefined == "eps":
        return n / (d + EPS)
    out = n / F.nullif(d.cast("double"), F.lit(0.0))
    return F.coalesce(out, F.lit(0.0)) if undefined == "zero" else out


def class_histogram(px: DataFrame, keys: Sequence[str] = ("tile_id",), label: str = "target", k: int = 3) -> DataFrame:
    """Pixels and percentage of each class by tile, zeros included."""
    counts = [F.count_if(F.col(label) == c).alias(f"n{c}") for c in range(k)]
    h = px.groupBy(*keys).agg(F.count("*").alias("n"), *counts)
    return h.withColumns({f"pct{c}": F.col(f"n{c}") * 100.0 / F.col("n") for c in range(k)})


def corpus_summary(px: DataFrame, label: str = "target", k: int = 3) -> DataFrame:
    """class_id, total, percentage, tiles that hold the class, and mean, median, least and most pixels of the tiles that do."""
    per = px.where(F.col(label).between(0, k - 1)).groupBy("tile_id", F.col(label).cast("int").alias("class_id")).agg(F.count("*").alias("n"))
    s = per.groupBy("class_id").agg(F.sum("n").alias("total"), F.count("*").alias("tiles"), F.avg("n").alias("mean"), F.percentile("n", F.lit(0.5)).alias("median"), F.min("n").alias("least"), F.max("n").alias("most"))
    return s.withColumn("pct", F.col("total") * 100.0 / F.sum("total").over(Window.partitionBy(F.lit(0))))


def split_table(px: DataFrame, splits: DataFrame, label: str = "target", k: int = 3, places: int = 6) -> DataFrame:
    """split (or Total), tiles, pixels, and counts and half-up percentages of each class."""
    # Tiles are counted from per-tile sums, so that pixels are aggregated once.
    per = px.groupBy("tile_id").agg(F.count("*").alias("n"), *[F.count_if(F.col(label) == c).alias(f"n{c}") for c in range(k)]).join(splits.select("tile_id", "split"), "tile_id")
    out = per.rollup("split").agg(F.grouping("split").alias("g"), F.count("*").alias("tiles"), F.sum("n").alias("pixels"), *[F.sum(f"n{c}").alias(f"n{c}") for c in range(k)])
    return out.select(F.when(F.col("g") == 1, "Total").otherwise(F.col("split")).alias("split"), "tiles", "pixels", *[F.col(f"n{c}") for c in range(k)], *[pct(F.col(f"n{c}"), F.col("pixels"), places).alias(f"pct{c}") for c in range(k)])


def class_statistics(px: DataFrame, splits: DataFrame, split: str = "train", label: str = "target", k: int = 3) -> DataFrame:
    """class_id and n over one split's tiles only; a class without pixels is an error."""
    own = px.join(splits.where(F.col("split") == split).select("tile_id"), "tile_id", "left_semi")
    sums = own.agg(*[F.count_if(F.col(label) == c).alias(str(c)) for c in range(k)])
    rows = sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("class_id"), F.col(str(c)).alias("n")) for c in range(k)])).alias("x")).select("x.*")
    return rows.withColumn("n", F.when(F.col("n") > 0, F.col("n")).otherwise(F.raise_error(F.concat(F.lit(f"{split} has no pixel of class "), F.col("class_id").cast("string"))).cast("bigint")))


def class_weights(counts: DataFrame) -> DataFrame:
    """Inverse square roots of the frequencies of the two pore classes, summing to 1."""
    w = counts.where(F.col("class_id") < 2)
    total = Window.partitionBy(F.lit(0))  # two rows
    w = w.withColumn("inverse", 1 / F.sqrt(F.col("n") / F.sum("n").over(total)))
    return w.select("class_id", "n", (F.col("inverse") / F.sum("inverse").over(total)).alias("weight"))


def grid_of(keys_df: DataFrame, k: int = 3) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(t).alias("true_id"), F.lit(p).alias("pred_id")) for t in range(k) for p in range(k)])
    return keys_df.select("*", F.explode(cells).alias("c")).select(*keys_df.columns, "c.*")


def confusion(px: DataFrame, keys: Sequence[str] = ("tile_id",), k: int = 3, target: str = "target", pred: str = "pred", ignore: int | None = None, weight: str | None = None) -> DataFrame:
    """k * k rows for each key, with n (or the sum of weights). A label outside 0..k-1 is an error; the ignored target and NULL targets are left out."""
    rows = px.where(F.col(target).isNotNull() & ((F.col(target) != ignore) if ignore is not None else F.lit(True)))
    fine = F.col(target).between(0, k - 1) & F.coalesce(F.col(pred).between(0, k - 1), F.lit(False))
    amount = F.lit(1) if weight is None else F.col(weight)
    bad = F.count_if(~fine)
    cells = [F.sum(F.when((F.col(target) == t) & (F.col(pred) == p), amount).otherwise(F.lit(0))).alias(f"c{t}_{p}") for t in range(k) for p in range(k)]
    wide = rows.groupBy(*keys).agg(bad.alias("bad"), *cells)
    long = wide.select(*keys, F.explode(F.array(*[F.struct(F.lit(t).alias("true_id"), F.lit(p).alias("pred_id"), F.col(f"c{t}_{p}").alias("n"), F.col("bad")) for t in range(k) for p in range(k)])).alias("x")).select(*keys, "x.*")
    kind = "bigint" if weight is None else "double"
    return long.select(*keys, "true_id", "pred_id", F.when(F.col("bad") == 0, F.col("n")).otherwise(F.raise_error(F.lit("label out of range")).cast(kind)).cast(kind).alias("n"))


def class_metrics(cm: DataFrame, keys: Sequence[str] = ("tile_id",), k: int = 3, undefined: str = "null") -> DataFrame:
    """tp, fp, fn, tn, support, iou, dice, precision, recall, specificity and accuracy of each class."""
    one = cm.withColumn("class_id", F.explode(F.array(*[F.lit(c) for c in range(k)])))
    t, p = F.col("true_id") == F.col("class_id"), F.col("pred_id") == F.col("class_id")
    s = one.groupBy(*keys, "class_id").agg(*[F.sum(F.when(c, F.col("n")).otherwise(0)).alias(n) for n, c in (("tp", t & p), ("fp", ~t & p), ("fn", t & ~p), ("tn", ~t & ~p))])
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    m = s.withColumns({"support": tp + fn, "iou": ratio(tp, tp + fp + fn, undefined), "precision": ratio(tp, tp + fp, undefined), "recall": ratio(tp, tp + fn, undefined), "specificity": ratio(tn, tn + fp, undefined), "accuracy": ratio(tp + tn, tp + fp + fn + tn, undefined)})
    dice = 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + EPS) if undefined == "eps" else ratio(2 * tp, 2 * tp + fp + fn, undefined)
    return m.withColumn("dice", dice)


def summary_metrics(m: DataFrame, keys: Sequence[str] = ("tile_id",), metrics: Sequence[str] = ("iou", "dice", "precision", "recall")) -> DataFrame:
    """Macro means of the defined classes, support-weighted means, micro values, accuracy, and the harmonic IoU of the pore classes."""
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    aggs = [F.avg(x).alias(f"macro_{x}") for x in metrics]
    aggs += [ratio(F.sum(F.col(x) * F.col("support")), F.sum(F.when(F.col(x).isNotNull(), F.col("support")))).alias(f"weighted_{x}") for x in metrics]
    aggs += [ratio(tp, tp + fp + fn).alias("micro_iou"), ratio(2 * tp, 2 * tp + fp + fn).alias("micro_dice"), ratio(tp, tp + fp).alias("micro_precision"), ratio(tp, tp + fn).alias("micro_recall"), ratio(tp, F.sum("support")).alias("accuracy")]
    aggs += [F.max(F.when(F.col("class_id") == c, F.col("iou"))).alias(f"c{c}_iou") for c in (0, 1)]
    return m.groupBy(*keys).agg(*aggs).withColumn("harmonic_iou", harmonic_iou(F.col("c0_iou"), F.col("c1_iou")))


def frequency_weighted(m: DataFrame, keys: Sequence[str] = ("tile_id",)) -> DataFrame:
    """Frequency-weighted and plain mean IoU in the form that training logs use (eps in each ratio)."""
    w = F.col("support") / (F.sum("support").over(Window.partitionBy(*keys)) + EPS)
    return m.withColumn("w", w).groupBy(*keys).agg(F.sum(F.col("w") * F.col("iou")).alias("frequency_iou"), F.avg("iou").alias("mean_iou"))


def harmonic_iou(c0: Column, c1: Column) -> Column:
    return 2 * c0 * c1 / (c0 + c1 + EPS)


def merge_classes(cm: DataFrame, mapping: dict[int, int], keys: Sequence[str] = ("tile_id",)) -> DataFrame:
    """Confusion counts with class ids mapped (pores 0 and 1 to 0, mineral 2 to 1)."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    to = lambda c: F.element_at(table, F.col(c)).alias(c)
    return cm.select(*keys, to("true_id"), to("pred_id"), "n").groupBy(*keys, "true_id", "pred_id").agg(F.sum("n").alias("n"))


PORE_VS_MINERAL = {0: 0, 1: 0, 2: 1}


def pore_union(cm: DataFrame, keys: Sequence[str] = ("tile_id",)) -> DataFrame:
    """IoU of both pore classes as one, and the share of pixels on which pore against mineral agrees."""
    m = class_metrics(merge_classes(cm, PORE_VS_MINERAL, keys), keys, 2)
    return m.groupBy(*keys).agg(F.max(F.when(F.col("class_id") == 0, F.col("iou"))).alias("pore_union_iou"), F.max(F.when(F.col("class_id") == 0, F.col("accuracy"))).alias("agreement"))


def gate_diagnostic(px: DataFrame, keys: Sequence[str] = ("tile_id",), t: int = 100) -> DataFrame:
    """The fixed gate against the reference's pores, by tile and in all: 2 x 2 counts, mismatches, and pore pixels outside the gate."""
    inside, pore = F.col("v") < t, F.col("target").isin(0, 1)
    cells = {"pore_in": pore & inside, "pore_out": pore & ~inside, "mineral_in": ~pore & inside, "mineral_out": ~pore & ~inside, "c0_outside": (F.col("target") == 0) & ~inside, "c1_outside": (F.col("target") == 1) & ~inside}
    g = px.rollup(*keys).agg(F.grouping(keys[0]).alias("pooled"), F.count("*").alias("pixels"), *[F.count_if(c).alias(n) for n, c in cells.items()])
    g = g.withColumn("mismatched", F.col("pore_out") + F.col("mineral_in")).withColumn("matched", F.col("pore_in") + F.col("mineral_out"))
    return g.withColumn("mismatch_rate", ratio(F.col("mismatched"), F.col("pixels"))).where((F.col("pooled") == 1) | F.col(keys[0]).isNotNull())


def tile_and_pooled(cm: DataFrame, tile: str = "tile_id", k: int = 3) -> DataFrame:
    """Tidy rows: scope (tile or pooled), tile, class_id, metric, value. Pooled metrics come from the summed matrix."""
    both = cm.rollup("true_id", "pred_id", tile).agg(F.grouping_id().alias("g"), F.sum("n").alias("n")).where(F.col("g").isin(0, 1))
    scoped = both.select(F.when(F.col("g") == 1, "pooled").otherwise("tile").alias("scope"), F.col(tile).cast("string").alias("tile"), "true_id", "pred_id", "n")
    m = class_metrics(scoped, ["scope", "tile"], k)
    names = ("iou", "dice", "precision", "recall")
    return m.select("scope", "tile", "class_id", F.explode(F.array(*[F.struct(F.lit(x).alias("metric"), F.col(x).alias("value")) for x in names])).alias("x")).select("scope", "tile", "class_id", "x.*")


def method_confusion(cm: DataFrame, method: str = "method_id") -> DataFrame:
    """Pooled counts by method with their share of the reference row and outcome; a class without reference pixels is an error."""
    p = cm.groupBy(method, "true_id", "pred_id").agg(F.sum("n").alias("n"))
    row = F.sum("n").over(Window.partitionBy(method, "true_id"))
    share = F.when(row > 0, F.col("n") / row).otherwise(F.raise_error(F.lit("a class has no reference pixels")).cast("double"))
    return p.withColumn("row_fraction", share).withColumn("outcome", F.when(F.col("true_id") == F.col("pred_id"), "correct").otherwise("error"))


def full_area_metrics(cm: DataFrame, method: str = "method_id", sources: dict[str, str] | None = None) -> DataFrame:
    """Mineral metrics and pore union of each method, with where its predictions come from."""
    pooled = cm.groupBy(method, "true_id", "pred_id").agg(F.sum("n").alias("n"))
    c2 = class_metrics(pooled, [method]).where("class_id = 2").select(method, *[F.col(x).alias(f"c2_{x}") for x in ("iou", "dice", "precision", "recall")])
    out = c2.join(pore_union(pooled, [method]), method)
    names = F.create_map(*[F.lit(x) for pair in (sources or {"": ""}).items() for x in pair])
    return out.withColumn("prediction_source", F.coalesce(F.try_element_at(names, F.col(method)), F.lit("model")))


def seed_summary(df: DataFrame, keys: Sequence[str] = ("method_id", "metric"), value: str = "value") -> DataFrame:
    """Mean and sample deviation over seeds, NULL if any value is; the deviation of one value is NULL."""
    complete = F.count("*") == F.count(value)
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.when(complete, F.avg(value)).alias("mean"), F.when(complete, F.stddev_samp(value)).alias("sd"))


def group_metrics(cm: DataFrame, group: str, keys: Sequence[str] = ()) -> DataFrame:
    """Metrics of each group's pooled matrix, averaged over groups (a mean of harmonic values, not the harmonic of means)."""
    pooled = cm.groupBy(*keys, group, "true_id", "pred_id").agg(F.sum("n").alias("n"))
    m = class_metrics(pooled, [*keys, group], undefined="zero")
    g = m.groupBy(*keys, group).agg(*[F.max(F.when(F.col("class_id") == c, F.col("iou"))).alias(f"c{c}_iou") for c in (0, 1)]).withColumn("harmonic_iou", harmonic_iou(F.col("c0_iou"), F.col("c1_iou")))
    return g.groupBy(*keys).agg(*[F.avg(x).alias(x) for x in ("c0_iou", "c1_iou", "harmonic_iou")], F.count("*").alias("groups"))


def score_histogram(df: DataFrame, bins: int = 4096, keys: Sequence[str] = ()) -> DataFrame:
    """One-vs-rest counts: class_id, bin_id, pos and neg; df has target and probs."""
    one = df.select(*keys, "target", F.posexplode("probs").alias("class_id", "p"))
    bin_id = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    return one.groupBy(*keys, "class_id", bin_id.alias("bin_id")).agg(F.count_if(F.col("target") == F.col("class_id")).alias("pos"), F.count_if(F.col("target") != F.col("class_id")).alias("neg"))


def complete_histogram(h: DataFrame, bins: int = 4096, k: int = 3) -> DataFrame:
    """Every class and bin, with zeros where nothing was counted, and the bins' edges score_lower and score_upper."""
    grid = h.sparkSession.range(k * bins).select(F.floor(F.col("id") / bins).cast("int").alias("class_id"), (F.col("id") % bins).cast("int").alias("bin_id"))
    filled = grid.join(h.select("class_id", "bin_id", "pos", "neg"), ["class_id", "bin_id"], "left").fillna(0, ["pos", "neg"])
    return filled.withColumns({"score_lower": F.col("bin_id") / float(bins), "score_upper": (F.col("bin_id") + 1) / float(bins)})


def check_histogram(h: DataFrame, cm: DataFrame, bins: int = 4096, k: int = 3) -> DataFrame:
    """Findings by class: bins outside the grid, missing or repeated bins, edges (where h has them) off the grid, positives other than the support, negatives other than the rest."""
    support = cm.groupBy(F.col("true_id").alias("class_id")).agg(F.sum("n").alias("support"))
    total = cm.agg(F.sum("n").alias("total"))
    edges = F.lit(False)
    if "score_lower" in h.columns:
        edges = ~is_close(F.col("score_lower"), F.col("bin_id") / float(bins)) | ~is_close(F.col("score_upper"), (F.col("bin_id") + 1) / float(bins))
    inside = F.col("bin_id").between(0, bins - 1)
    sums = h.groupBy("class_id").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.count_if(~inside).alias("outside"), F.count_distinct(F.when(inside, F.col("bin_id"))).alias("seen"), (F.count("*") - F.count_distinct("bin_id")).alias("repeated"), F.count_if(edges).alias("edges"))
    both = support.join(sums, "class_id", "full_outer").join(F.broadcast(total))
    checks = {
        "bin outside the grid": F.col("outside") > 0, "missing bin": F.coalesce(F.col("seen"), F.lit(0)) < bins, "repeated bin": F.col("repeated") > 0, "edges off the grid": F.col("edges") > 0,
        "positives differ from support": ~F.col("pos").eqNullSafe(F.col("support")), "negatives differ from the rest": ~F.col("neg").eqNullSafe(F.col("total") - F.col("support")), "class outside the grid": ~F.col("class_id").between(0, k - 1),
    }
    return both.select("class_id", F.explode(F.filter(F.array(*[F.when(c, n) for n, c in checks.items()]), lambda x: x.isNotNull())).alias("finding"))


def prevalence(px: DataFrame, label: str = "target", k: int = 3) -> DataFrame:
    """class_id, pixels and share over all masks; a value outside the classes is an error."""
    fine = F.when(F.col(label).between(0, k - 1), F.col(label)).otherwise(F.raise_error(F.concat(F.lit("unexpected mask value "), F.col(label).cast("string"))).cast("int"))
    n = px.groupBy(fine.cast("int").alias("class_id")).agg(F.count("*").alias("pixels"))
    return n.withColumn("share", F.col("pixels") / F.sum("pixels").over(Window.partitionBy(F.lit(0))))


def corpus_digest(files: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Digest of sorted names, sizes and content digests of each key: two levels, so that contents are hashed where they are.

    files has name, size and sha256. Names repeat never; a name list and a few dozen bytes per file meet in one row.
    """
    entry = F.concat_ws("\u0000", "name", F.col("size").cast("string"), "sha256")
    return files.groupBy(*keys).agg(F.count("*").alias("files"), F.sha2(F.array_join(F.array_sort(F.collect_list(entry)), "\n"), 256).alias("digest"), F.sha2(F.array_join(F.array_sort(F.collect_list("name")), "\n"), 256).alias("names_digest"))


def streamed_digests(files: DataFrame, keys: Sequence[str], columns: Sequence[str], begin: Callable[[], Any], add: Callable[..., None], end: Callable[[Any], tuple], schema: str) -> DataFrame:
    """One row for each key, made by taking its files in order of their names, one after the other: nothing of a key is held but the state."""
    named = [f"_k{i}" for i in range(len(keys))]
    picked = files.select(*[F.col(k).alias(n) for k, n in zip(keys, named, strict=True)], *columns)
    # A hash goes through a key's files in turn, so they pass through one task; they are sorted before and never meet in memory.
    dealt = picked.repartition(*named) if keys else picked.repartition(1)
    kinds = [picked.schema[n].dataType.simpleString() for n in named]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, done = None, None, []

        def flush() -> pa.RecordBatch:
            rows = [list(x) for x in zip(*done, strict=True)]
            done.clear()
            kinds_of = [batch.schema.field(n).type for n in named] + [pa.int64() if part.split()[1] == "bigint" else pa.string() for part in schema.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(rows, kinds_of, strict=True)], [*named, *[part.split()[0] for part in schema.split(", ")]])

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                key = row[: len(named)]
                if state is None or key != at:
                    if state is not None:
                        done.append((*at, *end(state)))
                    at, state = key, begin()
                add(state, *row[len(named) :])
            if len(done) > 1000:
                yield flush()
        if state is not None:
            done.append((*at, *end(state)))
            yield flush()

    out = dealt.sortWithinPartitions(*named, "name").mapInArrow(run, "".join(f"{n} {kind}, " for n, kind in zip(named, kinds, strict=True)) + schema)
    return out.toDF(*keys, *[part.split()[0] for part in schema.split(", ")])


def describe_counts(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """name, tiles, total, mean, median, least and most of counts by tile, one row for each column (ring pixels of each kind, pixels inside rings)."""
    long = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("bigint").alias("n")) for c in columns])).alias("x")).select(*keys, "x.*")
    return long.groupBy(*keys, "name").agg(F.count("n").alias("tiles"), F.sum("n").alias("total"), F.avg("n").alias("mean"), F.percentile("n", F.lit(0.5)).alias("median"), F.min("n").alias("least"), F.max("n").alias("most"))


def inside_histogram(px: DataFrame, label: str = "target", k: int = 3, inside: str = "inside") -> DataFrame:
    """Per tile: pixels, pixels inside rings, and those of each class inside and outside."""
    on = F.coalesce(F.col(inside), F.lit(False))
    counts = [F.count_if((on if side else ~on) & (F.col(label) == c)).alias(f"n{c}_{'inside' if side else 'outside'}") for c in range(k) for side in (True, False)]
    return px.groupBy("tile_id").agg(F.count("*").alias("pixels"), F.count_if(on).alias("n_inside"), *counts)


def byte_digest(files: DataFrame, keys: Sequence[str]) -> DataFrame:
    """files, image_digest and names_digest of the files (name, content) of each scope, in one pass over the bytes.

    image_digest: SHA-256 over name, NUL, content, NUL of each file by name; names_digest: that of the compact JSON list of names. NULL
    contents are empty.
    """

    def begin() -> dict:
        return {"n": 0, "bytes": hashlib.sha256(), "names": hashlib.sha256(b"[")}

    def add(state: dict, name: str, content: bytes | None) -> None:
        state["bytes"].update(name.encode() + b"\0")
        state["bytes"].update(content or b"")
        state["bytes"].update(b"\0")
        state["names"].update((("," if state["n"] else "") + json.dumps(name)).encode())
        state["n"] += 1

    def end(state: dict) -> tuple:
        state["names"].update(b"]")
        return state["n"], state["bytes"].hexdigest(), state["names"].hexdigest()

    kept = files.select(*keys, "name", F.col("content").cast("binary").alias("content"))
    return streamed_digests(kept, keys, ["name", "content"], begin, add, end, "files bigint, image_digest string, names_digest string")


#: The first bytes of a tree digest (a fixed value).
TREE_HEADER = b"public-snapshot-tree-v1\0"


def tree_digest(files: DataFrame, keys: Sequence[str] = (), header: bytes = TREE_HEADER) -> DataFrame:
    """files and tree_digest: SHA-256 of the header, then of each file by name: the length of the name and the name, the size, and the SHA-256
    of the content, lengths and sizes in eight bytes, the largest first. No lengths are left to guess, so no two trees have one stream.

    files has name (a relative path), size and sha256 (hexadecimal, made where the content lies); a NULL among them is an error.
    """

    def add(state: dict, name: str, size: int, digest: str) -> None:
        path = name.encode()
        state["tree"].update(len(path).to_bytes(8, "big") + path + size.to_bytes(8, "big") + bytes.fromhex(digest))
        state["n"] += 1

    return streamed_digests(files, keys, ["name", "size", "sha256"], lambda: {"n": 0, "tree": hashlib.sha256(header)}, add, lambda state: (state["n"], state["tree"].hexdigest()), "files bigint, tree_digest string")
