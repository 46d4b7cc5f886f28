"""Scalar expressions and row predicates. All are built-in Spark expressions; NULL inputs give NULL unless stated."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GATE = 100
IGNORE = -100
MINERAL = 2
#: Names that stand for the three classes (fixed values).
CATEGORY_IDS = {"disconnected_pore": 0, "connected_pore": 1, "mineral": 2}
CATEGORY_ALIASES = {"disconnected": "disconnected_pore", "isolated_pore": "disconnected_pore", "connected": "connected_pore", "background": "mineral", "matrix": "mineral"}


def gate(v: Column, t: int = GATE) -> Column:
    """Strictly below the threshold."""
    return v < t


def recode_mask(v: Column, num_classes: int = 3, ignore: int = IGNORE) -> Column:
    """0, 1 and 255 become 0, 1 and 2 (with two classes, 255 becomes ignore); any other value is NULL, a violation."""
    return F.when(v.isin(0, 1), v.cast("int")).when(v == 255, F.lit(2 if num_classes == 3 else ignore))


def mask_violations(df: DataFrame, v: str = "v") -> DataFrame:
    return df.where(F.col(v).isNull() | ~F.col(v).isin(0, 1, 255))


def normalise_category(name: Column, aliases: dict[str, str] | None = None) -> Column:
    """Trimmed, lowered, spaces and dashes as underscores, aliases resolved."""
    plain = F.regexp_replace(F.lower(F.trim(name)), "[ -]", "_")
    table = F.create_map(*[F.lit(x) for pair in (aliases or CATEGORY_ALIASES).items() for x in pair])
    return F.coalesce(F.try_element_at(table, plain), plain)


def category_id(name: Column) -> Column:
    """The class of a category name; NULL if unknown."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in CATEGORY_IDS.items() for x in pair]), normalise_category(name))


def normalise(v: Column) -> Column:
    return (v / 255.0 - 0.5) / 0.5


def normalised_gate(t: int = GATE) -> float:
    return 2 * t / 255 - 1


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue of 0 to 179, saturation and value of 0 to 255, from 8-bit channels."""
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    span = (high - low).cast("double")
    degrees = F.when(span == 0, 0.0).when(high == r, 60 * (g - b) / F.nullif(span, F.lit(0.0))).when(high == g, 120 + 60 * (b - r) / F.nullif(span, F.lit(0.0))).otherwise(240 + 60 * (r - g) / F.nullif(span, F.lit(0.0)))
    hue = F.round(F.when(degrees < 0, degrees + 360).otherwise(degrees) / 2) % 180
    return hue, F.round(F.when(high == 0, 0.0).otherwise(255 * span / F.nullif(high, F.lit(0)))), high.cast("double")


def lab(r: Column, g: Column, b: Column) -> tuple[Column, Column]:
    """The a and b channels of 8-bit Lab (128 is neutral)."""

    def linear(c: Column) -> Column:
        x = c / 255.0
        return F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, 2.4))

    def curve(t: Column) -> Column:
        return F.when(t > 0.008856, F.pow(t, 1 / 3)).otherwise(7.787 * t + 16 / 116)

    lr, lg, lb = linear(r), linear(g), linear(b)
    x = curve((0.412453 * lr + 0.357580 * lg + 0.180423 * lb) / 0.950456)
    y = curve(0.212671 * lr + 0.715160 * lg + 0.072169 * lb)
    z = curve((0.019334 * lr + 0.119193 * lg + 0.950227 * lb) / 1.088754)
    return F.round(500 * (x - y) + 128), F.round(200 * (y - z) + 128)


def ring_predicates(df: DataFrame, wrap_uint8: bool = False) -> DataFrame:
    """Adds one boolean for each way of finding a yellow ring, and ``ring``, their union. df has r, g and b.

    wrap_uint8 sums r + g in eight bits, as an unwidened sum would.
    """
    r, g, b = (F.col(x).cast("int") for x in "rgb")
    hue, saturation, value = hsv(r, g, b)
    a_lab, b_lab = lab(r, g, b)
    total = (r + g + b).cast("double")
    red_green = (r + g) % 256 if wrap_uint8 else r + g
    share = lambda x: F.coalesce(x / F.nullif(total, F.lit(0.0)), F.lit(0.0))
    ways = {
        "ring_hsv": hue.between(10, 50) & (saturation >= 50) & (value >= 50),
        "ring_lab": (a_lab > 128) & (b_lab > 150),
        "ring_ratio": (share(r) > 0.33) & (share(g) > 0.33) & (share(b) < 0.25) & (total > 100),
        "ring_rgb": (r > 150) & (g > 150) & (b < 100) & (red_green > 350),
        "ring_score": (r + g) / 2 - b > 80,
        "ring_strict": (r > 200) & (g > 200) & (b < 50) & hue.between(15, 35),
    }
    out = df.withColumns(ways)
    return out.withColumn("ring", F.expr(" or ".join(ways)))


def ring_counts(df: DataFrame, keys: Sequence[str] = ("tile_id",)) -> DataFrame:
    """Pixels found by each way, by tile."""
    names = [x for x in df.columns if x == "ring" or x.startswith("ring_")]
    return df.groupBy(*keys).agg(*[F.count_if(F.col(x)).alias(f"n_{x}") for x in names])


def check_grayscale(df: DataFrame, keys: Sequence[str] = ("tile_id",)) -> DataFrame:
    """Whether a tile has one channel (v), or equal channels r, g, b and, where there is an alpha, a full one, at all of its pixels."""
    one = F.col("v").isNotNull() if "v" in df.columns else F.lit(False)
    fine = (F.col("r") == F.col("g")) & (F.col("g") == F.col("b"))
    if "a" in df.columns:
        fine = fine & (F.coalesce(F.col("a"), F.lit(255)) == 255)
    return df.groupBy(*keys).agg(F.bool_and(F.when(one & F.col("r").isNull(), True).otherwise(F.coalesce(fine, F.lit(False)))).alias("is_grayscale"))


def is_safe_path(path: Column, prefix: str | None = None, suffix: str | None = None, top_level: bool = False) -> Column:
    """Relative, not empty, no backslash, no dot or dot-dot part; optionally below a prefix, with a suffix, or a bare name. NULL is unsafe."""
    parts = F.split(path, "/")
    fine = (F.length(path) > 0) & ~path.startswith("/") & ~path.contains("\\") & ~path.rlike("^[A-Za-z]:") & ~F.array_contains(parts, "..") & ~F.array_contains(parts, ".") & ~F.array_contains(parts, "")
    if prefix is not None:
        fine = fine & path.startswith(prefix.rstrip("/") + "/")
    if suffix is not None:
        fine = fine & path.endswith(suffix)
    if top_level:
        fine = fine & (F.size(parts) == 1)
    return F.coalesce(fine, F.lit(False))


def compose_labels(inside: Column, predicted: Column) -> Column:
    """The predicted class inside the gate, mineral outside."""
    return F.when(inside, predicted).otherwise(F.lit(MINERAL))


def compose_target(target: Column, ignore: int = IGNORE) -> Column:
    return F.when(target.isNull() | (target == ignore), F.lit(MINERAL)).otherwise(target)


def compose_probs(inside: Column, probs: Column) -> Column:
    """Two pore probabilities as three: [p0, p1, 0] inside the gate, [0, 0, 1] outside."""
    return F.when(inside, F.concat(F.slice(probs, 1, 2), F.array(F.lit(0.0)))).otherwise(F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0)))


def check_probs(probs: Column, arity: int = 3, edge: float = 1e-7, total: float = 2e-6) -> Column:
    """Whether there are ``arity`` finite values in [0, 1] that sum to 1, within small tolerances."""
    inside = F.forall(probs, lambda p: p.isNotNull() & ~F.isnan(p) & (p >= -edge) & (p <= 1 + edge))
    sums = F.abs(F.aggregate(probs, F.lit(0.0), lambda s, p: s + p) - 1) <= total
    return F.coalesce((F.size(probs) == arity) & inside & sums, F.lit(False))


def argmax_class(probs: Column) -> Column:
    """The first class of the highest probability."""
    return (F.array_position(probs, F.array_max(probs)) - 1).cast("int")


def quantise(p: Column) -> Column:
    return F.floor(F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)) * 255 + 0.5).cast("int")


def error_category(target: Column, predicted: Column) -> Column:
    return F.when(target == predicted, 0).otherwise(target + 1).cast("int")


def parse_float(text: Column) -> Column:
    """A finite number, else NULL."""
    x = F.trim(text).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def run_name(path: Column) -> Column:
    """The folder that holds a file; of one that begins with run_, what follows its third underscore (or the last, if there are fewer)."""
    parent = F.try_element_at(F.split(path, "/"), F.lit(-2))
    return F.when(parent.startswith("run_"), F.element_at(F.split(parent, "_", 4), -1)).otherwise(parent)


def run_group(path: Column) -> Column:
    """candidate below a folder candidates; else the folder below ablation; else patch_training if it is a part of the path; else other."""
    parts = F.split(path, "/")
    at = F.array_position(parts, "ablation")
    return (
        F.when(F.array_contains(parts, "candidates"), "candidate").when(at > 0, F.coalesce(F.get(parts, at.cast("int")), F.lit("ablation")))
        .when(F.array_contains(parts, "patch_training"), "patch_training").otherwise("other")
    )


def colourise(df: DataFrame, label: str, colours: Sequence[tuple[int, int, int]] = ((255, 0, 0), (0, 255, 0), (0, 0, 255))) -> DataFrame:
    """Adds r, g and b of each class."""
    pick = lambda k: F.get(F.array(*[F.lit(c[k]) for c in colours]), F.col(label).cast("int"))
    return df.withColumns({"r": pick(0), "g": pick(1), "b": pick(2)})


def pct(n: Column, total: Column, k: int = 6) -> Column:
    """Percentage, decimal and rounded half up to k places; NULL for a total of zero."""
    return F.round((100 * n).cast("decimal(38,0)").cast("decimal(30,12)") / F.nullif(total, F.lit(0)).cast("decimal(20,0)"), k)


def canonical_json(cols: Sequence[str]) -> Column:
    return F.to_json(F.struct(*sorted(cols)), {"ignoreNullFields": "false"})


def content_id(cols: Sequence[str], prefix: str) -> Column:
    """prefix and 16 hex digits of the canonical JSON of the columns."""
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(canonical_json(cols), 256), 1, 16))


def is_sha256(text: Column) -> Column:
    return F.coalesce(text.rlike("^[0-9a-f]{64}$"), F.lit(False))


def is_close(a: Column, b: Column, rel: float = 1e-9, abs_: float = 1e-12) -> Column:
    """Both NULL, or close relative to the larger; one NULL is a mismatch."""
    near = F.abs(a - b) <= F.greatest(rel * F.greatest(F.abs(a), F.abs(b)), F.lit(abs_))
    return F.when(a.isNull() & b.isNull(), True).when(a.isNull() | b.isNull(), False).otherwise(near)


def worst_class(c0: Column, c1: Column, tie: float = 1e-15) -> Column:
    return F.when(c0.isNull() | c1.isNull(), "undefined").when(F.abs(c0 - c1) <= tie, "tie").when(c0 < c1, "C0").otherwise("C1")


def glob_regex(glob: str) -> str:
    """A shell glob as a whole-string pattern; * and ? cross slashes."""
    out, k = "", 0
    while k < len(glob):
        c = glob[k]
        end = glob.find("]", k + 2) if c == "[" else -1
        if end > 0:
            inner = glob[k + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]"
            k = end
        else:
            out += {"*": ".*", "?": "."}.get(c, re.escape(c))
        k += 1
    return f"(?s)^{out}$"


def matches_any(path: Column, globs: Sequence[str]) -> Column:
    hit = F.lit(False)
    for glob in globs:
        hit = hit | path.rlike(glob_regex(glob))
    return hit


def log_softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    total = F.log(F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top)))
    return F.transform(logits, lambda x: x - top - total)


def softmax(logits: Column) -> Column:
    return F.transform(log_softmax(logits), lambda x: F.exp(x))
