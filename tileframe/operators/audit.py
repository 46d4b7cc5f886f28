"""Consistency and governance: every check returns its findings as rows; no rows means nothing was found."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tileframe.functions import canonical_json, is_close, is_safe_path, is_sha256, matches_any, worst_class
from tileframe.operators.metrics import class_metrics, corpus_digest, ratio, seed_summary
from tileframe.operators.pairing import contrast_by_seed

#: What leaks look like (fixed values).
LEAK_PATTERNS = {
    "private key": r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----",
    "GitHub token": r"\b(?:gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,})\b",
    "AWS access key": r"\bAKIA[0-9A-Z]{16}\b",
    "Google API key": r"\bAIza[0-9A-Za-z_-]{30,}\b",
    "Hugging Face token": r"\bhf_[A-Za-z0-9]{20,}\b",
    "OpenAI-style key": r"\bsk-(?:proj-)?[A-Za-z0-9_-]{20,}\b",
    "literal credential assignment": r"(?i)(?:api[_-]?key|access[_-]?token|password|secret)\s*[:=]\s*['\"](?![<$\{])[^'\"]{8,}['\"]",
    "Weights & Biases API key": r"(?i)\bWANDB_API_KEY\b\s*[:=]\s*['\"]?[a-f0-9]{40}\b",
    "email address": r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b",
    "macOS home path": r"/Users/[A-Za-z0-9._-]+/",
    "Linux home path": r"/home/[A-Za-z0-9._-]+/",
    "HPC scratch path": r"/mnt/(?:scratch|lustre|nobackup)/",
}


def check_leakage(m: DataFrame, ident: str = "image_id") -> DataFrame:
    """ident, splits and finding: in more than one split, or repeated within one."""
    per = m.groupBy(ident, "split").agg(F.count("*").alias("n"))
    g = per.groupBy(ident).agg(F.array_join(F.array_sort(F.collect_set("split")), ",").alias("splits"), F.count("*").alias("k"), F.max("n").alias("most"))
    finding = F.when(F.col("k") > 1, "in several splits").when(F.col("most") > 1, "repeated in a split")
    return g.withColumn("finding", finding).where("finding is not null").select(ident, "splits", "finding")


def check_complete(m: DataFrame, images: DataFrame, ident: str = "image_id") -> DataFrame:
    """Index ids without a split, and manifest ids that the index lacks."""
    a, b = images.select(F.col("id").alias(ident)), m.select(ident)
    return a.subtract(b).withColumn("finding", F.lit("not assigned")).unionByName(b.subtract(a).withColumn("finding", F.lit("unknown")))


def diff_names(a: DataFrame, b: DataFrame, name: str = "name") -> DataFrame:
    """Names that b lacks (missing) or has beyond a (unexpected), as often as they do."""
    x, y = a.select(name), b.select(name)
    return x.exceptAll(y).withColumn("finding", F.lit("missing")).unionByName(y.exceptAll(x).withColumn("finding", F.lit("unexpected")))


def check_constant(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Keys whose rows don't all have the same values in cols; NULL is a value."""
    return df.groupBy(*keys).agg(F.count_distinct(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})).alias("variants")).where("variants > 1")


def scan_patterns(df: DataFrame, patterns: Mapping[str, str] | None = None, path: str = "path", content: str = "content", usernames: Sequence[str] = ()) -> DataFrame:
    """path, pattern, line (of the first match) and match. Bytes are read as Latin-1, so binaries are scanned too."""
    used = dict(patterns if patterns is not None else LEAK_PATTERNS)
    if usernames:
        used["username"] = r"(?i)\b(?:" + "|".join(usernames) + r")\b"
    text = F.decode(F.col(content), "ISO-8859-1") if dict(df.dtypes)[content] == "binary" else F.col(content)
    t = df.select(F.col(path).alias("path"), text.alias("text"))
    # One pass for all patterns: a row comes out only where one matches.
    hits = F.filter(F.array(*[F.when(F.col("text").rlike(p), F.struct(F.lit(n).alias("pattern"), F.regexp_instr("text", F.lit(p)).alias("at"), F.regexp_extract("text", p, 0).alias("match"))) for n, p in used.items()]), lambda x: x.isNotNull())
    each = t.withColumn("h", F.explode_outer(hits)).where("h is not null")
    line = F.length(F.substring("text", F.lit(1), F.col("h.at") - 1)) - F.length(F.replace(F.substring("text", F.lit(1), F.col("h.at") - 1), F.lit("\n"), F.lit(""))) + 1
    return each.select("path", "h.pattern", line.alias("line"), "h.match")


def audit_paths(df: DataFrame, forbidden: Sequence[str], diagnostic: Sequence[str] = (), pdf_folder: str | None = None, path: str = "path") -> DataFrame:
    """path and finding: forbidden, a diagnostic asset, a PDF outside its folder, or unsafe."""
    p = F.col(path)
    checks = [F.when(matches_any(p, forbidden), "forbidden path"), F.when(matches_any(p, diagnostic), "diagnostic asset"), F.when(~is_safe_path(p), "unsafe path")]
    if pdf_folder is not None:
        checks.append(F.when(F.lower(p).endswith(".pdf") & ~p.startswith(pdf_folder.rstrip("/") + "/"), "misplaced PDF"))
    return df.select(p.alias("path"), F.explode_outer(F.filter(F.array(*checks), lambda x: x.isNotNull())).alias("finding")).where("finding is not null")


def audit_approvals(paths: DataFrame, approvals: DataFrame, text_fields: Sequence[str] = ()) -> DataFrame:
    """path and finding: each selected path needs exactly one complete approved record.

    approvals has schema_version, template_only and assets (paths, approval_status, approval_date, two flags and text fields).
    """
    doc = approvals.select(F.col("template_only").alias("template"), F.explode("assets").alias("a"))
    rec = doc.select("template", "a.*").withColumn("record", F.monotonically_increasing_id())
    absent = [F.col(c).isNull() | (F.trim(c) == "") for c in text_fields]
    problem = F.array(
        F.when(F.coalesce("template", F.lit(True)), "template only"), F.when(~F.col("approval_status").eqNullSafe(F.lit("approved")), "not approved"),
        F.when(F.expr("try_to_date(approval_date, 'yyyy-MM-dd')").isNull(), "bad date"), F.when(F.col("contains_source_image_pixels").isNull() | F.col("contains_annotation_or_mask_pixels").isNull(), "flag missing"),
        F.when(F.size("paths") == 0, "no paths"), *[F.when(x, f"{c} is empty") for x, c in zip(absent, text_fields, strict=True)],
    )
    each = rec.select("record", F.explode("paths").alias("path"), F.filter(problem, lambda x: x.isNotNull()).alias("problems"))
    unsafe = each.where(~is_safe_path(F.col("path"))).select("path", F.lit("unsafe path").alias("finding"))
    faulty = each.select("path", F.explode("problems").alias("finding"))
    repeated = each.groupBy("path").agg(F.count("*").alias("n")).where("n > 1").select("path", F.lit("several records").alias("finding"))
    have = each.select("path").distinct()
    missing = paths.select("path").distinct().join(have, "path", "left_anti").select("path", F.lit("no record").alias("finding"))
    return unsafe.unionByName(faulty).unionByName(repeated).unionByName(missing).distinct()


def diff_bytes(a: DataFrame, b: DataFrame) -> DataFrame:
    """Shared paths whose contents differ."""
    one = a.select("path", F.sha2("content", 256).alias("a_sha256"))
    two = b.select("path", F.sha2("content", 256).alias("b_sha256"))
    return one.join(two, "path").where("a_sha256 <> b_sha256")


def attest(files: DataFrame, scopes: DataFrame, expected: DataFrame) -> DataFrame:
    """scope, observed and expected counts and digests, and whether both agree; a file may be in several scopes."""
    seen = corpus_digest(files.join(scopes.select("name", "scope"), "name"), ["scope"])
    both = expected.select("scope", F.col("files").alias("expected_files"), F.col("digest").alias("expected_digest")).join(seen, "scope", "full_outer")
    return both.select("scope", "files", "expected_files", "digest", "expected_digest", (F.col("files").eqNullSafe(F.col("expected_files")) & F.col("digest").eqNullSafe(F.col("expected_digest"))).alias("attested"))


def json_kinds(c: Column) -> dict[str, Column]:
    """Whether a JSON text is a value of a kind; a number that is not a whole one, a quoted number or a truth value is no integer."""
    text = F.trim(c.cast("string"))
    number = text.rlike(r"^-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?$")
    return {"is_number": number, "is_integer": text.rlike(r"^-?(?:0|[1-9][0-9]*)$"), "is_string": text.rlike(r'(?s)^".*"$'), "is_boolean": text.isin("true", "false")}


def rule(kind: str, col: str) -> Column:
    """Whether a column keeps a rule: positive, count, unit, text, sha256, present; or, for JSON texts, is_number, is_integer, is_string, is_boolean."""
    c = F.col(col)
    return F.coalesce({"positive": c > 0, "count": (c >= 0) & (c == F.floor(c)), "unit": (c >= 0) & (c <= 1), "text": F.trim(c) != "", "sha256": is_sha256(c), "present": c.isNotNull(), **json_kinds(c)}[kind], F.lit(False))


def check_records(df: DataFrame, rules: Mapping[str, str], key: str) -> DataFrame:
    """key, column and finding for each broken rule; a column that is not there, or not foreseen, is a finding of all rows."""
    known = {c: k for c, k in rules.items() if c in df.columns}
    tests = [F.when(~rule(k, c), F.struct(F.lit(c).alias("column"), F.lit(f"not {k}").alias("finding"))) for c, k in known.items()]
    odd = [(c, "missing column") for c in rules if c not in df.columns] + [(c, "unexpected column") for c in df.columns if c not in rules and c != key]
    tests += [F.struct(F.lit(c).alias("column"), F.lit(f).alias("finding")) for c, f in odd]
    return df.select(F.col(key), F.explode_outer(F.filter(F.array(*tests), lambda x: x.isNotNull())).alias("f")).where("f is not null").select(key, "f.*")


def check_report(tiles: DataFrame, cm: DataFrame, reported: DataFrame, aggregate: DataFrame | None = None, shape: tuple[int, int] | None = None) -> DataFrame:
    """tile and finding: a matrix that doesn't sum to height * width, a repeated tile name, another shape than the given one, tile numbers that don't run
    from 1, a reported IoU that isn't the matrix's, or (tile NULL) an aggregate matrix that isn't the sum of the tiles'.

    tiles has tile, height and width, and ordinal if numbers are to be looked at; cm tile, true_id, pred_id and n; reported tile, class_id and
    iou; aggregate true_id, pred_id and n.
    """
    sums = cm.groupBy("tile").agg(F.sum("n").alias("n"))
    area = tiles.groupBy("tile").agg(F.count("*").alias("times"), F.max(F.col("height").cast("bigint") * F.col("width")).alias("area")).join(sums, "tile", "full_outer")
    a = area.select("tile", F.explode_outer(F.filter(F.array(F.when(F.col("times") > 1, "repeated tile"), F.when(~F.col("n").eqNullSafe(F.col("area")), "matrix does not cover the tile")), lambda x: x.isNotNull())).alias("finding")).where("finding is not null")
    m = class_metrics(cm, ["tile"]).select("tile", "class_id", F.col("iou").alias("own"))
    b = m.join(reported, ["tile", "class_id"], "full_outer").where(~is_close(F.col("own"), F.col("iou"))).select("tile", F.concat(F.lit("iou of class "), F.col("class_id").cast("string")).alias("finding"))
    out = a.unionByName(b)
    if shape is not None:
        out = out.unionByName(tiles.where(~(F.col("height").eqNullSafe(F.lit(shape[0])) & F.col("width").eqNullSafe(F.lit(shape[1])))).select("tile", F.lit("another shape").alias("finding")).distinct())
    none = F.lit(None).cast(cm.schema["tile"].dataType).alias("tile")
    if "ordinal" in tiles.columns:
        n = tiles.agg(F.count("*").alias("n"), F.count_distinct("ordinal").alias("d"), F.min("ordinal").alias("a"), F.max("ordinal").alias("b"))
        out = out.unionByName(n.where("n > 0 and not (d = n and a <=> 1 and b <=> n)").select(none, F.lit("tile numbers don't run from 1").alias("finding")))
    if aggregate is not None:
        sums = cm.groupBy("true_id", "pred_id").agg(F.sum("n").alias("own"))
        apart = sums.join(aggregate.groupBy("true_id", "pred_id").agg(F.sum("n").alias("told")), ["true_id", "pred_id"], "full_outer").where("coalesce(own, 0) <> coalesce(told, 0)")
        out = out.unionByName(apart.agg(F.count("*").alias("k")).where("k > 0").select(none, F.concat(F.lit("aggregate differs in "), F.col("k").cast("string"), F.lit(" cells")).alias("finding")))
    return out


def check_collection(df: DataFrame, required: Mapping[str, int]) -> DataFrame:
    """method_id and finding over records with method_id, seed, kind, display_name and selected."""
    g = df.groupBy("method_id").agg(F.count("*").alias("n"), F.count_distinct(F.coalesce(F.col("seed").cast("string"), F.lit("-"))).alias("d"), F.count_distinct("display_name").alias("names"), F.first("kind").alias("kind"), F.count_distinct("kind").alias("kinds"))
    need = F.try_element_at(F.create_map(*[F.lit(x) for p in required.items() for x in p]), F.col("kind"))
    tests = [F.when(F.col("n") > F.col("d"), "repeated seed"), F.when(F.col("names") != 1, "several display names"), F.when(F.col("kinds") != 1, "several kinds"), F.when(need.isNull() | (F.col("n") != need), "wrong number of records")]
    each = g.select("method_id", F.explode_outer(F.filter(F.array(*tests), lambda x: x.isNotNull())).alias("finding")).where("finding is not null")
    chosen = df.where("selected").agg(F.count_distinct("method_id").alias("k")).where("k <> 1").select(F.lit("*").alias("method_id"), F.lit("not exactly one selected method").alias("finding"))
    return each.unionByName(chosen)


def dedupe_by_identity(df: DataFrame, ignore: Sequence[str]) -> DataFrame:
    """One row for each set of records that are equal up to the ignored columns, with its identity and how many there were."""
    cols = [c for c in df.columns if c not in ignore]
    keyed = df.withColumn("identity", F.sha2(canonical_json(cols), 256))
    return keyed.groupBy("identity").agg(*[F.first(c).alias(c) for c in cols], F.count("*").alias("copies"))


def tile_errors(cm: DataFrame, reference: str) -> DataFrame:
    """Per method, seed and tile: C0/C1 and pore/mineral confusions, supports, IoUs, the worse class, and the contrast of harmonic IoU to the reference."""
    keys = ["method_id", "seed", "tile"]
    n = lambda t, p: F.sum(F.when((F.col("true_id") == t) & (F.col("pred_id") == p), F.col("n")).otherwise(0))
    counts = cm.groupBy(*keys).agg(n(0, 1).alias("c0_as_c1"), n(1, 0).alias("c1_as_c0"), (n(0, 2) + n(1, 2)).alias("pore_as_mineral"), (n(2, 0) + n(2, 1)).alias("mineral_as_pore"), *[(n(t, 0) + n(t, 1) + n(t, 2)).alias(f"support{t}") for t in range(3)], *[ratio(n(t, t), n(t, 0) + n(t, 1) + n(t, 2) + n(0, t) + n(1, t) + n(2, t) - n(t, t)).alias(f"c{t}_iou") for t in range(3)])
    c = counts.withColumn("worst_class", worst_class(F.col("c0_iou"), F.col("c1_iou"))).withColumn("value", 2 * F.col("c0_iou") * F.col("c1_iou") / (F.col("c0_iou") + F.col("c1_iou") + 1e-8))
    ref = c.where(F.col("method_id") == reference).groupBy("tile").agg(F.when(F.count("*") == F.count("value"), F.avg("value")).alias("mean_ref"))
    own = c.where(F.col("method_id") == reference).select("seed", "tile", F.col("value").alias("seed_ref"))
    out = c.join(own, ["seed", "tile"], "left").join(ref, "tile", "left")
    base = F.when(F.col("method_id") == reference, F.lit(None).cast("double")).otherwise(F.coalesce("seed_ref", F.when(F.col("seed").isNull(), F.col("mean_ref"))))
    return out.withColumn("contrast", base - F.col("value")).withColumnRenamed("value", "harmonic_iou").drop("seed_ref", "mean_ref")


def screen_summary(df: DataFrame, reference: str) -> DataFrame:
    """candidate, metric, mean, sd and mean margin (candidate less reference, same seed) of tidy metrics (method_id, seed, metric, value)."""
    s = seed_summary(df)
    m = contrast_by_seed(df, reference).groupBy("method_id", "metric").agg(F.avg(-F.col("difference")).alias("margin"))
    return s.join(m, ["method_id", "metric"], "left")


