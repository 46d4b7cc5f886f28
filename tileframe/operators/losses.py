"""Scores of predicted probabilities, as grouped sums. df has target (class id) and probs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _true_p(floor: float = 1e-7) -> Column:
    return F.greatest(F.get("probs", F.col("target").cast("int")), F.lit(floor))


def _pick(values: Sequence[float], at: Column) -> Column:
    return F.get(F.array(*[F.lit(float(x)) for x in values]), at.cast("int"))


def log_losses(df: DataFrame, keys: Sequence[str] = (), gamma: float = 2.0, alpha: Sequence[float] | None = None, ignore: int | None = -100) -> DataFrame:
    """cross_entropy and focal loss, plain and weighted means over the pixels that aren't ignored."""
    d = df.where(F.col("target").isNotNull() & (F.col("target") != ignore)) if ignore is not None else df
    p = _true_p()
    w = _pick(alpha, F.col("target")) if alpha else F.lit(1.0)
    ce = -F.log(p)
    focal = w * F.pow(1 - p, gamma) * ce
    return d.groupBy(*keys).agg(F.avg(ce).alias("cross_entropy"), F.avg(focal).alias("focal"), (F.sum(w * ce) / F.sum(w)).alias("weighted_cross_entropy"), F.count("*").alias("pixels"))


def asymmetric_focal(df: DataFrame, keys: Sequence[str] = (), gamma_pos: float = 2.0, gamma_neg: float = 4.0, alpha_pos: Sequence[float] | None = None, alpha_neg: Sequence[float] | None = None, edge: float = 1e-7) -> DataFrame:
    """Mean over pixels of the sum over classes of the positive term of the target and the negative terms of the others, each weighted by class."""

    def term(p: Column, k: Column) -> Column:
        pos = -F.pow(1 - p, gamma_pos) * F.log(F.greatest(p, F.lit(edge)))
        neg = -F.pow(p, gamma_neg) * F.log(F.greatest(1 - p, F.lit(edge)))
        return F.when(k == F.col("target"), pos * _pick(alpha_pos, k) if alpha_pos else pos).otherwise(neg * _pick(alpha_neg, k) if alpha_neg else neg)

    return df.groupBy(*keys).agg(F.avg(F.aggregate(F.transform("probs", term), F.lit(0.0), lambda s, x: s + x)).alias("asymmetric_focal"))


def _overlaps(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    one = df.select(*keys, "target", F.posexplode("probs").alias("class_id", "p"))
    t = (F.col("target") == F.col("class_id")).cast("double")
    return one.groupBy(*keys, "class_id").agg(F.sum(F.col("p") * t).alias("tp"), F.sum("p").alias("p"), F.sum(t).alias("t"), F.count("*").alias("n"))


def soft_dice(df: DataFrame, keys: Sequence[str] = (), smooth: float = 1.0) -> DataFrame:
    """Soft Dice of each class, and as class_id -1 their mean."""
    d = _overlaps(df, keys).select(*keys, "class_id", ((2 * F.col("tp") + smooth) / (F.col("p") + F.col("t") + smooth)).alias("dice"))
    return d.unionByName(d.groupBy(*keys).agg(F.avg("dice").alias("dice")).withColumn("class_id", F.lit(-1)))


def tversky(df: DataFrame, keys: Sequence[str] = ("tile_id",), alpha: float = 0.7, beta: float = 0.3, gamma: float = 2.0, smooth: float = 1e-6, adaptive: bool = False, weights: Sequence[float] | None = None) -> DataFrame:
    """Tversky index and focal Tversky loss, weighted over classes: alpha weighs false positives, beta false negatives.

    Adaptive: a class of under 1 % of the pixels has 0.7 and 0.3, under 20 % 0.6 and 0.4, else 0.3 and 0.7.
    """
    o = _overlaps(df, keys).withColumn("share", F.col("t") / F.col("n"))
    a = F.when(F.col("share") < 0.01, 0.7).when(F.col("share") < 0.2, 0.6).otherwise(0.3) if adaptive else F.lit(alpha)
    b = F.when(F.col("share") < 0.01, 0.3).when(F.col("share") < 0.2, 0.4).otherwise(0.7) if adaptive else F.lit(beta)
    fn, fp = F.col("t") - F.col("tp"), F.col("p") - F.col("tp")
    o = o.withColumn("index", (F.col("tp") + smooth) / (F.col("tp") + a * fp + b * fn + smooth))
    w = _pick(weights, F.col("class_id")) if weights else F.lit(1.0)
    return o.groupBy(*keys).agg((F.sum(w * F.col("index")) / F.sum(w)).alias("tversky"), (F.sum(w * F.pow(F.greatest(1 - F.col("index"), F.lit(0.0)), gamma)) / F.sum(w)).alias("focal_tversky"))


def hierarchical_score(df: DataFrame, pore_counts: tuple[int, int], keys: Sequence[str] = (), smooth: float = 1e-6, weights: tuple[float, float, float] = (1.0, 1.0, 1.0), ignore: int = -100) -> DataFrame:
    """Soft Dice losses of all classes, of the union of pores, and of C0 against C1 within true pores, and their weighted mean.

    The last weighs its classes by the inverse square roots of their shares in ``pore_counts``, the training pixels of C0 and C1. Pixels
    with the ignored or no target don't count; keys without any other are left out.
    """
    p, t = lambda k: F.get("probs", F.lit(k)), lambda k: (F.col("target") == k).cast("double")
    pore, is_pore = p(0) + p(1), t(0) + t(1)
    within = lambda k: F.coalesce(p(k) / F.nullif(pore, F.lit(0.0)), F.lit(0.0)) * is_pore
    lost = lambda a, b: 1 - (2 * F.sum(a * b) + smooth) / (F.sum(a) + F.sum(b) + smooth)
    rarity = [(sum(pore_counts) / n) ** 0.5 for n in pore_counts]
    c0, c1 = (r / sum(rarity) for r in rarity)
    valid = df.where(F.col("target").isNotNull() & (F.col("target") != ignore))
    out = valid.groupBy(*keys).agg(
        ((lost(p(0), t(0)) + lost(p(1), t(1)) + lost(p(2), t(2))) / 3).alias("region"), lost(pore, is_pore).alias("pore_union"),
        (c0 * lost(within(0), t(0)) + c1 * lost(within(1), t(1))).alias("conditional"),
    )
    a, b, c = (w / sum(weights) for w in weights)
    return out.withColumn("loss", a * F.col("region") + b * F.col("pore_union") + c * F.col("conditional"))


def sparse_score(
    df: DataFrame, keys: Sequence[str] = ("tile_id",), gamma: float = 2.0, false_pore: float = 10.0, true_pore: float = 3.0, rest: float = 1.0, expected: float = 0.15, ignore: int = -100
) -> DataFrame:
    """Focal loss that weighs pores predicted on mineral and pores of the right class more, times 1 + 10 * excess where more pores than expected are predicted.

    Pixels with the ignored or no target don't count; keys without any other have a loss of 0.
    """
    found = F.array_position("probs", F.array_max("probs")) - 1
    valid = F.col("target").isNotNull() & (F.col("target") != ignore)
    p = _true_p()
    weight = F.when((found < 2) & (F.col("target") == 2), F.lit(false_pore)).when((found < 2) & (found == F.col("target")), F.lit(true_pore)).when((found == 2) & (F.col("target") == 2), F.lit(rest)).otherwise(1.0)
    term = F.when(valid, weight * F.pow(1 - p, gamma) * -F.log(p))
    pore = F.when(valid, F.when(found < 2, 1.0).otherwise(0.0))
    s = df.groupBy(*keys).agg(F.coalesce(F.avg(term), F.lit(0.0)).alias("focal"), F.coalesce(F.avg(pore), F.lit(0.0)).alias("pore_ratio"))
    return s.withColumn("score", F.col("focal") * F.when(F.col("pore_ratio") > expected, 1 + 10 * (F.col("pore_ratio") - expected)).otherwise(1.0))


def pair_separation(df: DataFrame, block: str, margin: float = 1.0, tau: float = 0.07, vector: str = "embedding", label: str = "label") -> DataFrame:
    """Within each block: (sum of s over same-class pairs + sum of max(margin - s, 0) over all cells with same-class ones at s = 0) / N^2, s = cosine / tau.

    So same-class cells add the margin too, and the diagonal counts as the rest.
    Blocks are batches of bounded size, chosen by the caller.
    """
    x = F.transform(F.col(vector).cast("array<double>"), lambda v: v)
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    unit = df.select(F.col(block).alias("block"), F.col(label).alias("label"), F.monotonically_increasing_id().alias("id"), F.transform(x, lambda v: v / F.greatest(norm, F.lit(1e-12))).alias("u"))
    a, b = unit, unit.select(F.col("block"), F.col("label").alias("label_b"), F.col("id").alias("id_b"), F.col("u").alias("u_b"))
    dot = F.aggregate(F.zip_with("u", "u_b", lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    cell = a.join(b, "block").select("block", (dot / tau).alias("s"), ((F.col("label") == F.col("label_b")) & (F.col("id") != F.col("id_b"))).alias("same"))
    term = F.when(F.col("same"), F.col("s") + margin).otherwise(F.greatest(margin - F.col("s"), F.lit(0.0)))
    return cell.groupBy("block").agg((F.sum(term) / F.count("*")).alias("separation"), F.sqrt(F.count("*").cast("double")).cast("bigint").alias("n"))


