"""The registered queries of the text operators and, where SQL can express them, the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tileframe.llm import bpe, decontaminate, htmltext, language, lm, neardup, shards, tokenfile, tokens, topk, toxicity, variants, vectorcodes
from tileframe.llm.common import fold, new_path, table

TOXIC_AT = 0.3


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"))
    counted = tokens.count_tokens(docs, tokenizer("word_bpe_49k.json"), ["doc_id", "n_bytes"])
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5, scale=256)
    return found.withColumn("score", F.col("score").cast("bigint"))


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.interleave(table(spark, sf_dir, "documents"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))


def bpe_digests(docs: DataFrame) -> DataFrame:
    coded = bpe.encode(docs, tokenizer("byte_bpe_50k.json"), ["doc_id"], decoded="decoded")
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), 3, 90, 100).select("doc_id", "n_shingles", "component_id")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 5) == 0
    profiles = language.fit_profiles(docs, ~held_out)
    return language.predict_language(docs.withColumn("held_out", held_out), profiles, ["doc_id", "held_out"])


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 4) == 2
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels").where(~held_out))
    scored = toxicity.score_toxicity(docs.withColumn("held_out", held_out), model, ["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= TOXIC_AT).cast("int"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    tokenfile.write_token_files(table(spark, sf_dir, "documents"), path, tokenizer("word_bpe_49k.json"), end_id=1)
    return tokenfile.ids_crc32(tokenfile.read_token_files(spark, path))


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    books = vectorcodes.fit_codebooks(vectors)
    coded = vectorcodes.encode(vectors, books, {"vec_id": F.col("vec_id"), "label": F.col("label")})
    return vectorcodes.with_group_sum(coded, "label", "error", "label_error").select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = htmltext.extract_text(pages, htmltext.fit_weights(pages), ["page_id", "url"])
    return found.withColumn("n_chars", F.length("text").cast("bigint"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(variants.vocabulary(table(spark, sf_dir, "documents"), every=97))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontaminate, op2_token_counts, op3_top_k, op4_shards, op5_bpe_round_trip, op6_ngram_jaccard, op7_language, op8_toxicity, op9_token_files, op10_lm_scores, op11_vector_codes, op12_html_text, op13_spelling_variants)}


OP1_SQL = r"""
WITH items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
sized AS (SELECT item, w, least(len(w), 13) AS l FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, l, array_to_string(w[i:i + l - 1], ' ') AS win FROM (SELECT item, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM sized)),
docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
spans AS (SELECT d.doc_id, d.i, d.l, d.win FROM (SELECT doc_id, l, i, array_to_string(w[i:i + l - 1], ' ') AS win FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM docs, (SELECT DISTINCT l FROM sized))) d SEMI JOIN windows v ON d.win = v.win AND d.l = v.l),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM spans) GROUP BY 1),
met AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT s.doc_id, v.item FROM spans s JOIN windows v ON s.win = v.win AND s.l = v.l) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM docs d LEFT JOIN hit USING (doc_id) LEFT JOIN met USING (doc_id)
"""

OP3_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.x) = len(c.x))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


OP4_SQL = """
WITH RECURSIVE steps AS (SELECT CAST(i AS BIGINT) AS i, CAST(i AS BIGINT) AS c, 0 AS k FROM range(256) r(i) UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
d AS (SELECT doc_id, coalesce('=' || source, '') AS s, octet_length(encode(coalesce(text, ''))) + 16 AS size, ('0x' || substr(md5(concat_ws(':', '42', doc_id)), 1, 10))::BIGINT AS h, ('0x' || substr(md5(concat_ws(':', '42', doc_id)), 11, 10))::BIGINT AS u,
  list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda b: CAST('0x' || b AS BIGINT)) AS bytes FROM documents),
c AS (SELECT doc_id, s, size, h, u, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], bytes), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32 FROM d, crc),
f AS (SELECT *, (row_number() OVER (PARTITION BY s ORDER BY h, doc_id) - u / 1099511627776::DOUBLE) / (count(*) OVER (PARTITION BY s))::DOUBLE AS f FROM c),
p AS (SELECT *, row_number() OVER (ORDER BY f, h, s, doc_id) - 1 AS p, count(*) OVER () AS n FROM f)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'rows' AS law, CAST(p * 40 // n AS INTEGER) AS shard, CAST(p - (p * 40 // n * n + 39) // 40 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM p
"""

OP6_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g FROM d),
n AS (SELECT doc_id, CAST(len(g) AS BIGINT) AS n FROM s),
e AS (SELECT doc_id, unnest(g) AS t FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM e a JOIN e b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS root FROM n UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.node)
SELECT doc_id, n AS n_shingles, root AS component_id FROM n JOIN (SELECT node, min(root) AS root FROM r GROUP BY 1) ON node = doc_id
"""

OP11_HEAD = """
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS MATERIALIZED (SELECT r, p, x[p * (len(x) // 16) + 1:(p + 1) * (len(x) // 16)] AS x FROM v, range(16) t(p)),
e0 AS MATERIALIZED (SELECT p, k, x FROM p JOIN (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, x) - 1 AS k FROM v) USING (r) WHERE k < 64),
"""

#: Assigns parts to the entries of a round: the least of 64 * distance + index.
OP11_NEAREST = """
a{i} AS MATERIALIZED (SELECT p.r, p.p, min(64 * CAST(list_sum(list_transform(list_zip(p.x, e.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) + e.k) AS m, any_value(p.x) AS x FROM p JOIN e{i} e ON p.p = e.p GROUP BY 1, 2),
"""

OP11_MOVED = """
m{i} AS MATERIALIZED (SELECT p, k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS x FROM (
    SELECT p, m % 64 AS k, j, CAST(sum(y) AS BIGINT) AS s, count(*) AS n FROM (SELECT p, m, unnest(x) AS y, generate_subscripts(x, 1) AS j FROM a{i}) GROUP BY 1, 2, 3) GROUP BY 1, 2),
e{j} AS MATERIALIZED (SELECT p, k, coalesce(m.x, e.x) AS x FROM e{i} e LEFT JOIN m{i} m USING (p, k)),
"""

OP11_TAIL = """
c AS (SELECT r, string_agg(printf('%02x', m % 64), '' ORDER BY p) AS code, CAST(sum(m // 64) AS BIGINT) AS error FROM a2 GROUP BY 1),
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, k)) AS h FROM e2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM v JOIN c USING (r), h
"""

OP11_SQL = OP11_HEAD + OP11_NEAREST.format(i=0) + OP11_MOVED.format(i=0, j=1) + OP11_NEAREST.format(i=1) + OP11_MOVED.format(i=1, j=2) + OP11_NEAREST.format(i=2) + OP11_TAIL

#: For pages whose article stands in one article element of headings, paragraphs, bold print and line breaks.
OP12_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS a FROM pages),
b AS (SELECT page_id, url, list_transform(regexp_split_to_array(regexp_replace(regexp_replace(a, '</?b>', '', 'g'), '<br>', ' ', 'g'), '</?(?:h1|p)>'),
  lambda x: trim(regexp_replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g'))) AS b FROM a),
t AS (SELECT page_id, url, array_to_string(list_filter(b, lambda x: x <> ''), chr(10)) AS text FROM b)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM t
"""

OP13_SQL = r"""
WITH RECURSIVE steps AS (SELECT CAST(i AS BIGINT) AS i, CAST(i AS BIGINT) AS c, 0 AS k FROM range(256) r(i) UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
r AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS w FROM documents) GROUP BY 1, 2 HAVING length(w) >= 5),
b AS (SELECT w, n, list_transform(regexp_extract_all(hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)), '..'), lambda b: CAST('0x' || b AS BIGINT)) AS bytes FROM r),
h AS (SELECT w, n, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], bytes), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM b, crc),
v AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, CAST(h % length(w) AS BIGINT)) || substr(w, CAST(h % length(w) AS BIGINT) + 2) ELSE w END AS word, n FROM h) WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
d AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS cut FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
p AS (SELECT d.word AS a, v.word AS b FROM d JOIN v ON d.cut = v.word UNION SELECT v.word, d.word FROM d JOIN v ON d.cut = v.word UNION SELECT x.word, y.word FROM d x JOIN d y ON x.cut = y.cut AND x.i = y.i AND x.word <> y.word),
q AS (SELECT a AS word, count(*) AS n_near, min(struct_pack(m := -v.n, w := b)) AS best FROM p JOIN v ON v.word = b GROUP BY 1),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.m >= 2 * v.n THEN best.w END AS form, CASE WHEN -best.m >= 2 * v.n THEN -best.m END AS form_n FROM v LEFT JOIN q USING (word)),
g AS (SELECT word, word AS root, 0 AS k FROM f UNION ALL SELECT g.word, f.form, k + 1 FROM g JOIN f ON f.word = g.root WHERE f.form IS NOT NULL)
SELECT f.word, form, root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM f JOIN (SELECT word, arg_max(root, k) AS root FROM g GROUP BY 1) USING (word)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": OP1_SQL, "op3_top_k": OP3_SQL, "op4_shards": OP4_SQL, "op6_ngram_jaccard": OP6_SQL, "op11_vector_codes": OP11_SQL, "op12_html_text": OP12_SQL, "op13_spelling_variants": OP13_SQL}
