"""The pipeline's rows against the same decisions taken one by one in plain Python."""

import hashlib
import zlib

import corpus_pipeline
from pyspark.sql import functions as F

from tests.llm.test_text_operators import SF, brute_components, brute_hits, brute_score, library, near_copies
from tileframe.llm import toxicity


def crc(i):
    return zlib.crc32(str(i).encode())


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    for _, stage in corpus_pipeline.STAGES[:2]:
        assert stage(spark, docs, SF).columns == docs.columns
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_pipeline(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = spark.createDataFrame(rows, "doc_id bigint, text string")
    taught = spark.createDataFrame([(i, y) for i, y in label.items() if crc(i) % 4 != 2], "doc_id bigint, toxic int")
    model = toxicity.fit_toxicity(kept, taught)
    rows = [(i, t) for i, t in rows if brute_score(model, t) < 0.3]
    first = {c for i, n, c in brute_components(rows, 5, 8, 10) if n} | {i for i, n, _ in brute_components(rows, 5, 8, 10) if not n}
    rows = [(i, t) for i, t in rows if i in first]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {d for d, n, hit, _ in brute_hits(rows, items) if not (hit and 20 * hit >= n)}
    t = library("byte_bpe_50k.json")
    want = {}
    for i, text in rows:
        if i in clean:
            ids = t.encode(text, add_special_tokens=False).ids
            want[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and len(want) > 100


def test_near_copies_at_the_required_similarity(spark):
    given = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("text is not null")
    docs = given.unionByName(spark.createDataFrame(near_copies(12, 5, 120, 5), "doc_id bigint, text string"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    required = brute_components(rows, 5, 8, 10)
    want = {c for _, n, c in required if n} | {i for i, n, _ in required if not n}
    got = corpus_pipeline.drop_near_copies(spark, docs, SF).collect()
    assert {r.doc_id for r in got} == want and len(got) == len(want)
    assert want != {c for _, _, c in brute_components(rows, 3, 90, 100)}


def test_awkward_rows(spark, tmp_path):
    """NULL, empty, letterless and repeated rows, ties, NULL ids, and columns with the names that stages use: each stage by its own rule."""
    texts = [None, "", "12 34", "the same text with letters", "the same text with letters", "the same text with letters", "another text " * 40, "word"]
    ids = [1, 2, 3, 4, 5, 5, 6, None]
    docs = spark.createDataFrame([(i, t, "en", "web") for i, t in zip(ids, texts, strict=True)], "doc_id bigint, text string, lang string, source string").withColumns({"n_chars": F.length("text"), "score": F.lit("clash"), "ids": F.lit("clash"), "n_words": F.lit("clash")})
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    told = corpus_pipeline.identify_language(spark, docs, str(tmp_path))
    assert sorted(str(r.doc_id) for r in told.collect()) == ["4", "5", "5", "6", "None"]
    mild = corpus_pipeline.drop_toxic(spark, told, str(tmp_path))
    assert mild.columns == docs.columns and mild.count() <= 5
    single = corpus_pipeline.drop_near_copies(spark, told, str(tmp_path))
    assert sorted(str(r.doc_id) for r in single.collect()) == ["4", "6", "None"] and single.columns == docs.columns
    clean = corpus_pipeline.drop_contaminated(spark, single, str(tmp_path))
    assert clean.count() == 3 and clean.columns == docs.columns
    coded = corpus_pipeline.encode(spark, docs, str(tmp_path)).collect()
    assert len(coded) == 8 and {r.n_tokens for r in coded if r.doc_id in (1, 2)} == {0}


def test_stages_of_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).collect() == []
