"""The registered queries by name: against DuckDB SQL where there is some, else against the libraries and brute force; and empty tables."""

import collections
import hashlib
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from pyspark.sql import functions as F

from tests.llm.test_text_operators import SF, brute_score, library
from tileframe.llm import bpe, language, lm, neardup, queries, shards, tokenfile, tokens, topk, toxicity
from tileframe.llm.common import new_path


def crc(i):
    return zlib.crc32(str(i).encode())


@pytest.fixture(scope="module")
def given(spark):
    return {r.doc_id: (r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    df = queries.queries()[name](spark, SF)
    assert sorted(names) == sorted(df.columns)
    assert sorted(str([r[n] for n in names]) for r in df.collect()) == sorted(str(list(r)) for r in cur.fetchall())


def test_token_counts_query(spark, given):
    t = library("word_bpe_49k.json")
    got = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op2_token_counts(spark, SF).collect()}
    assert got == {(i, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 2048) for i, (x, _) in given.items()}


def test_bpe_query(spark, given):
    t = library("byte_bpe_50k.json")
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op5_bpe_round_trip(spark, SF).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = {(i, len(ids := t.encode(x or "", add_special_tokens=False).ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))) for i, (x, _) in given.items()}
    assert got == want


def codes(text):
    """All letter n-grams of a text as the operator's numbers, one by one."""
    marked, last = [0], False
    for c in text.lower():
        if c.isalpha() or last:
            marked.append(ord(c) if c.isalpha() else 0)
        last = c.isalpha()
    marked.append(0)
    for k, a in enumerate(marked):
        if a:
            yield a + 0x110000
            yield marked[k - 1] << 42 | a << 21 | marked[k + 1]
        if k + 1 < len(marked) and (a or marked[k + 1]):
            yield -(a << 21 | marked[k + 1]) - 1


def top(counts, size=language.PROFILE):
    return [c for c, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:size]]


def test_language_query(spark, given):
    """Profiles and out-of-place distances worked out one n-gram at a time."""
    counts = collections.defaultdict(collections.Counter)
    for i, (text, lang) in given.items():
        if lang is not None and text is not None and crc(i) % 5:
            counts[lang].update(codes(text))
    ranks = {lang: {c: k for k, c in enumerate(top(n))} for lang, n in counts.items()}
    got = {r.doc_id: (r.held_out, r.lang_pred, r.score) for r in queries.op7_language(spark, SF).collect()}
    right = []
    for i, (text, lang) in given.items():
        own = top(collections.Counter(codes(text or "")))
        far = sorted((sum(abs(k - r[c]) if c in r else language.PROFILE for k, c in enumerate(own)), name) for name, r in ranks.items())
        want = (far[0][1], (far[1][0] - far[0][0]) / far[1][0] if far[1][0] else 0.0) if own else (language.UNKNOWN, 0.0)
        assert got[i] == (crc(i) % 5 == 0, want[0], pytest.approx(want[1]))
        if crc(i) % 5 == 0 and lang is not None and own:
            right.append(want[0] == lang)
    assert np.mean(right) > 0.95


def test_toxicity_query(spark, given):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    taught = spark.createDataFrame([(r.doc_id, r.toxic) for r in labels.collect() if crc(r.doc_id) % 4 != 2], "doc_id bigint, toxic int")
    model = toxicity.fit_toxicity(docs, taught)
    got = {r.doc_id: (r.held_out, r.score, r.predicted) for r in queries.op8_toxicity(spark, SF).collect()}
    assert set(got) == set(given)
    for i, (text, _) in given.items():
        score = brute_score(model, text)
        assert got[i] == (crc(i) % 4 == 2, pytest.approx(score, rel=1e-6), int(got[i][1] >= 0.3))


def test_token_files_query(spark, given):
    t = library("word_bpe_49k.json")
    want, start = set(), 0
    for i in sorted(given):
        ids = [*t.encode(given[i][0] or "", add_special_tokens=False).ids, 1]
        want.add((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert {(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in queries.op9_token_files(spark, SF).collect()} == want


def test_file_format(spark, tmp_path):
    """Ids by dictionary, numbers by deltas, page indexes, and more row groups and pages where they are asked to be small."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    path = f"{tmp_path}/tokens"
    tokenfile.write_token_files(docs, path, queries.tokenizer("word_bpe_49k.json"), 1, partitions=2, row_group_bytes=64 << 10, page_bytes=4 << 10)
    files = sorted(Path(path).glob("*.parquet"))
    assert len(files) == 2
    for file in files:
        meta = pq.ParquetFile(file).metadata
        assert meta.num_row_groups > 1
        for g in range(meta.num_row_groups):
            for c in range(meta.num_columns):
                column = meta.row_group(g).column(c)
                assert column.has_offset_index and column.has_column_index
                if column.path_in_schema.startswith("ids"):
                    assert "RLE_DICTIONARY" in column.encodings
                if column.path_in_schema in ("doc_id", "local_start"):
                    assert "DELTA_BINARY_PACKED" in column.encodings or "RLE_DICTIONARY" in column.encodings
    narrow = tokenfile.read_token_files(spark, path, with_ids=False).where("doc_id < 20")
    assert narrow.count() == docs.where("doc_id < 20").count()


def test_scores_query(spark, given):
    got = {r.doc_id: r for r in queries.op10_lm_scores(spark, SF).collect()}
    assert set(got) == set(given) and all((r.lm_score is None) == (r.n_scored == 0) for r in got.values())
    # Exact copies are scored by each other, so nearly every trigram of theirs is known.
    times = collections.Counter(x for x, _ in given.values() if x and len(x) > 200)
    twice = [got[i].lm_score for i, (x, _) in given.items() if times[x] > 1]
    once = [got[i].lm_score for i, (x, _) in given.items() if times[x] == 1]
    assert twice and np.median(twice) > np.quantile(once, 0.9)


def test_empty_tables(spark):
    """No rows in, no rows out."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").where("false")
    word, byte = queries.tokenizer("word_bpe_49k.json"), queries.tokenizer("byte_bpe_50k.json")
    path = new_path(spark, "tokens")
    tokenfile.write_token_files(docs, path, word, 1, partitions=2)
    outs = [
        tokens.count_tokens(docs, word, ["doc_id"]), topk.top_k(vectors, F.col("vec_id") % 50 == 0, 5, scale=256), shards.interleave(docs, 4), bpe.encode(docs, byte, ["doc_id"], decoded="back"), neardup.near_duplicates(docs),
        language.predict_language(docs, language.fit_profiles(docs, F.lit(True)), ["doc_id"]), tokenfile.ids_crc32(tokenfile.read_token_files(spark, path)), lm.lm_scores(docs, word),
    ]
    assert [x.collect() for x in outs] == [[]] * len(outs)


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "one two", 5, 6)], "doc_id bigint, text string, n_tokens int, ids int")
    word, byte = queries.tokenizer("word_bpe_49k.json"), queries.tokenizer("byte_bpe_50k.json")
    for f in (lambda: tokens.count_tokens(docs, word, ["n_tokens"]), lambda: bpe.encode(docs, byte, ["ids"]), lambda: language.predict_language(docs.withColumnRenamed("ids", "score"), {}, ["score"])):
        with pytest.raises(ValueError):
            f()
    assert tokens.count_tokens(docs, word, ["n_tokens"], out="n").first().n == 2
