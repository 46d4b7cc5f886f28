"""Ordered state and choices under fixed tie rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tileframe.operators.ranks import ranked_by_value


def ordinal(df: DataFrame, order: Sequence[str], keys: Sequence[str], name: str = "ordinal") -> DataFrame:
    """Numbers from 1 within keys."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def check_contiguous(df: DataFrame, keys: Sequence[str], name: str = "ordinal") -> DataFrame:
    """Keys whose numbers don't run from 1 without gaps or repeats."""
    g = df.groupBy(*keys).agg(F.min(name).alias("least"), F.max(name).alias("most"), F.count("*").alias("n"), F.count_distinct(name).alias("d"))
    return g.where("least <> 1 or most <> n or d <> n").select(*keys, "least", "most", "n")


def running_best(log: DataFrame, run: str = "run_id") -> DataFrame:
    """Adds improved and best_epoch: the best so far by (score, tie_breaker, lower val_loss), strictly better to improve."""
    key = F.struct(F.col("score"), F.col("tie_breaker"), (-F.col("val_loss")).alias("neg_loss"))
    before = Window.partitionBy(run).orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    best = F.max(key).over(before)
    out = log.withColumn("improved", best.isNull() | (key > best))
    reason = F.when(best.isNull(), "first").when(~F.col("improved"), "none").when(F.col("score") > best["score"], "score").when(F.col("tie_breaker") > best["tie_breaker"], "tie_breaker").otherwise("val_loss")
    upto = Window.partitionBy(run).orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("reason", reason).withColumn("best_epoch", F.last(F.when(F.col("improved"), F.col("epoch")), ignorenulls=True).over(upto))


def early_stop(log: DataFrame, patience: int, run: str = "run_id") -> DataFrame:
    """run, best_epoch at the stop and stop_epoch: the first epoch with ``patience`` epochs since an improvement; NULL if none."""
    w = running_best(log, run).withColumn("waited", F.col("epoch") - F.col("best_epoch"))
    return w.groupBy(run).agg(F.min(F.when(F.col("waited") >= patience, F.col("epoch"))).alias("stop_epoch"), F.max("epoch").alias("last_epoch"), F.min_by("best_epoch", F.when(F.col("waited") >= patience, F.col("epoch"))).alias("best_epoch"))


def spread_sample(df: DataFrame, n: int, order: str) -> DataFrame:
    """n rows evenly spaced in order, both ends included; all rows if there are n or fewer."""
    k = ranked_by_value(df, order).withColumn("_k", F.col("_k") - 1)
    picks = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * (F.col("_t") - 1) / F.lit(float(max(1, n - 1)))))
    return k.where((F.col("_t") <= n) | F.array_contains(picks, F.col("_k").cast("bigint"))).drop("_k", "_t")


def rank_runs(df: DataFrame, first: str, second: str, n: int = 20, places: int = 4) -> DataFrame:
    """The n best runs by two metrics, descending, NULLs last, metrics rounded."""
    return df.orderBy(F.desc_nulls_last(first), F.desc_nulls_last(second), *[c for c in df.columns if c not in (first, second)]).limit(n).withColumns({first: F.round(first, places), second: F.round(second, places)})


def best_runs(df: DataFrame, metric: str, n: int = 15, tie: str = "run_name") -> DataFrame:
    """The n best runs of those that have the metric."""
    return df.where(F.col(metric).isNotNull()).orderBy(F.desc(metric), tie).limit(n)


def hard_examples(df: DataFrame, k: int, sample: str = "tile_id") -> DataFrame:
    """The k samples of the greatest mean cross-entropy; df has target and probs."""
    p = F.greatest(F.get("probs", F.col("target").cast("int")), F.lit(1e-7))
    return df.groupBy(sample).agg(F.avg(-F.log(p)).alias("loss")).orderBy(F.desc("loss"), sample).limit(k)


def keep_hard(df: DataFrame, ratio: float, min_samples: int, batch: str = "batch", loss: str = "loss", tie: str = "id") -> DataFrame:
    """Of each batch of N the max(floor(N * ratio), min(min_samples, N)) rows of greatest loss."""
    n = F.count("*").over(Window.partitionBy(batch))
    w = Window.partitionBy(batch).orderBy(F.desc(loss), tie)
    return df.withColumn("_n", n).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= F.greatest(F.floor(F.col("_n") * ratio), F.least(F.lit(min_samples), F.col("_n")))).drop("_n", "_r")


def first_tile(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The tile that is first by name and id."""
    return df.groupBy(*keys).agg(F.min(F.struct("name", "tile_id")).alias("x")).select(*keys, "x.*")


def select_cutoff(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Ranks of cutoffs: score descending, then the lesser of both IoUs descending, then the cutoff ascending; rank 1 is selected."""
    w = Window.partitionBy(*keys or [F.lit(0)]).orderBy(F.desc("harmonic_iou"), F.desc(F.least("c0_iou", "c1_iou")), "cutoff")
    return df.withColumn("rank", F.row_number().over(w)).withColumn("selected", F.col("rank") == 1)


def outcome_summary(df: DataFrame) -> DataFrame:
    """successes, failures and failed seeds of each candidate."""
    ok = F.col("outcome") == "success"
    return df.groupBy("candidate").agg(F.count_if(ok).alias("successes"), F.count_if(~ok).alias("failures"), F.array_sort(F.collect_list(F.when(~ok, F.col("seed")))).alias("failed_seeds"))


def select_candidate(df: DataFrame, reference: str, seeds: int) -> DataFrame:
    """Each candidate's means, whether it is eligible and why not, and the winner.

    Eligible: all seeds succeeded, mean score above the reference's, neither pore IoU below it. Winner: best score, then union IoU, then
    lower loss; an exact tie is an error, as is an incomplete reference.
    """
    ok = df.where("outcome = 'success'")
    names = ("score", "c0_iou", "c1_iou", "pore_union_iou", "validation_loss")
    m = df.select("candidate").distinct().join(ok.groupBy("candidate").agg(F.count_distinct("seed").alias("n"), *[F.avg(x).alias(x) for x in names]), "candidate", "left")
    ref = m.where(F.col("candidate") == reference).select(*[F.when(F.col("n") == seeds, F.col(x)).otherwise(F.raise_error(F.lit("the reference lacks a seed")).cast("double")).alias(f"ref_{x}") for x in ("score", "c0_iou", "c1_iou")])
    c = m.join(F.broadcast(ref))
    reason = F.when(F.col("candidate") == reference, "reference").when(F.coalesce(F.col("n"), F.lit(0)) < seeds, "missing seed").when(~(F.col("score") > F.col("ref_score")), "score not above reference").when(F.col("c0_iou") < F.col("ref_c0_iou"), "c0 below reference").when(F.col("c1_iou") < F.col("ref_c1_iou"), "c1 below reference")
    c = c.withColumn("reason", reason).withColumn("eligible", F.col("reason").isNull())
    key = F.when(F.col("eligible"), F.struct("score", "pore_union_iou", (-F.col("validation_loss")).alias("neg_loss")))
    whole = Window.partitionBy(F.lit(0))  # one row for each candidate
    c = c.withColumn("_k", key).withColumn("_best", F.max("_k").over(whole)).withColumn("_ties", F.count_if(F.col("_k") == F.col("_best")).over(whole))
    winner = F.when(F.col("_ties") > 1, F.raise_error(F.lit("exact tie for the best candidate")).cast("boolean")).otherwise(F.coalesce(F.col("_k") == F.col("_best"), F.lit(False)))
    return c.select("candidate", "n", *names, "eligible", "reason", winner.alias("winner"))


