"""Each text operator against a brute-force version, on given documents and on a table of awkward cases."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tileframe.llm import bpe, decontaminate, language, lm, neardup, queries, shards, tokenfile, tokens, topk, toxicity
from tileframe.llm.common import new_path, slices

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
ODD = [
    (1, None), (2, ""), (3, "   "), (4, "one"), (5, "One two"), (6, "a  b\n\n c\t d   e "), (7, "Ünï cödé ÉCOLE 日本語 テスト 🙂🙂"), (8, "x<|endoftext|>y <|startoftext|> z"),
    (9, LONG), (10, LONG), (11, "it's we're I'll 1234 ... !!!"), (11, "it's we're I'll 1234 ... !!!"), (12, "a" * 3000), (13, "the the the the the the the the the the the the the the the"),
    (14, "\r\n x \x1c y \x85 z w"), (None, "no id here at all"), (15, "é ́ Å"), (16, "tab\tand  two spaces   three\n  end  "),
]


@pytest.fixture(scope="module")
def docs(spark):
    given = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source", "lang")
    odd = spark.createDataFrame([(i if i is None else 10**6 + i, t) for i, t in ODD], "doc_id bigint, text string")
    return given.unionByName(odd.withColumn("source", F.when(F.col("doc_id") % 2 == 0, "odd")).withColumn("lang", F.lit(None).cast("string"))).withColumn("word", F.lit("clash")).withColumn("n_tokens", F.lit(-1)).repartition(5).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text, r.source) for r in docs.collect()]


def library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer(name))
    t.no_padding()
    t.no_truncation()
    return t


def bag(items):
    return collections.Counter(items)


def test_token_counts(docs, rows):
    t = library("word_bpe_49k.json")
    got = tokens.count_tokens(docs, queries.tokenizer("word_bpe_49k.json"), ["doc_id"]).collect()
    assert bag((r.doc_id, r.n_tokens) for r in got) == bag((i, len(t.encode(x or "", add_special_tokens=False).ids)) for i, x, _ in rows)


def test_bpe_round_trip(docs, rows):
    t = library("byte_bpe_50k.json")
    got = bpe.encode(docs, queries.tokenizer("byte_bpe_50k.json"), ["doc_id"], decoded="back").collect()
    want = bag((i, tuple(ids := t.encode(x or "", add_special_tokens=False).ids), t.decode(ids, skip_special_tokens=False)) for i, x, _ in rows)
    assert bag((r.doc_id, tuple(r.ids), r.back) for r in got) == want


def test_decode_alone(spark):
    t = library("byte_bpe_50k.json")
    lists = [[], [50256, 1, 2], [188, 200, 201], None]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lists)], "k int, ids array<int>")
    got = {r.k: r.text for r in bpe.decode(df, queries.tokenizer("byte_bpe_50k.json"), ["k"]).collect()}
    assert got == {k: t.decode(x or [], skip_special_tokens=False) for k, x in enumerate(lists)}


def test_token_files(spark, docs, rows):
    t = library("word_bpe_49k.json")
    path = new_path(spark, "tokens")
    tokenfile.write_token_files(docs, path, queries.tokenizer("word_bpe_49k.json"), 1, partitions=3)
    got = tokenfile.ids_crc32(tokenfile.read_token_files(spark, path)).collect()
    want = bag((i, len(ids := t.encode(x or "", add_special_tokens=False).ids + [1]), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, x, _ in rows)
    assert bag((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at, last = 0, -1
    for r in sorted(got, key=lambda r: (r.start, r.n_tokens)):
        assert r.start == at and (r.doc_id or 0) >= last
        at, last = at + r.n_tokens, r.doc_id or 0
    light = tokenfile.read_token_files(spark, path, with_ids=False)
    assert "ids:" not in light._jdf.queryExecution().executedPlan().toString()


def ascii_words(text, pattern):
    return re.findall(pattern, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_hits(docs, items, span=13):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = collections.defaultdict(set)
    for item, text in items:
        w = ascii_words(text, pattern)
        n = min(span, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[k : k + n])].add(str(item))
    sizes = {len(x) for x in windows}
    for doc, text in docs:
        w = ascii_words(text, pattern)
        hit, met = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= {*range(k, k + n)}
                    met |= windows[tuple(w[k : k + n])]
        yield doc, len(w), len(hit), tuple(sorted(met))


@pytest.mark.parametrize("extra", [[], [(-1, "the the"), (-2, None), (-3, "..."), (-4, "One two"), (-5, "the " * 20), (-5, "Ünï cödé ÉCOLE 日本語")]])
def test_decontamination(spark, docs, rows, extra):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text")
    if extra:
        bench = bench.unionByName(spark.createDataFrame(extra, "item_id bigint, text string"))
    got = decontaminate.contaminate(docs, bench).collect()
    want = bag(brute_hits([(i, x) for i, x, _ in rows], [(r.item_id, r.text) for r in bench.collect()]))
    assert bag((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in got) == want
    assert any(x[2] for x in want)


def test_decontamination_with_joins_dealt_out(spark, docs, rows, monkeypatch):
    """Beyond the bounds of broadcasts: no partition gets all rows that have no hit."""
    for name in ("BROADCAST_PRINTS", "BROADCAST_WINDOWS", "BROADCAST_TOUCHED"):
        monkeypatch.setattr(decontaminate, name, -1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        bench = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text")
        got = decontaminate.contaminate(docs, bench).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = bag(brute_hits([(i, x) for i, x, _ in rows], [(r.item_id, r.text) for r in bench.collect()]))
    assert bag((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in got) == want


def test_decontamination_with_empty_tables(docs):
    none = docs.where("false").select(F.col("doc_id").alias("item_id"), "text")
    assert {(r.n_hit, tuple(r.item_ids)) for r in decontaminate.contaminate(docs, none).collect()} == {(0, ())}
    assert decontaminate.contaminate(docs.where("false"), docs.select(F.col("doc_id").alias("item_id"), "text")).collect() == []


def brute_components(rows, width, num, den):
    sets = []
    for _, text in rows:
        w = [x for x in ascii_words(text, r"[^\x20\x09-\x0D]+")]
        sets.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and min(len(sets[a]), len(sets[b])) * den >= num * max(len(sets[a]), len(sets[b])) and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                up[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if sets[k]:
            least[find(k)] = min((x for x in (least.get(find(k)), i) if x is not None), default=None)
    return [(i, len(sets[k]), least[find(k)] if sets[k] and least[find(k)] is not None else i) for k, (i, _) in enumerate(rows)]


def near_copies(n, seed, words=120, most=14):
    random.seed(seed)
    base = [f"b{random.randrange(10**6)}" for _ in range(words)]
    out = []
    for k in range(n):
        w = list(base)
        for _ in range(random.randrange(most)):
            w[random.randrange(len(w))] = f"c{random.randrange(10**6)}"
        out.append((2 * 10**6 + seed * 10**5 + k, " ".join(w)))
    return out


@pytest.mark.parametrize("nulls", [True, False])
def test_slices_of_batches(nulls):
    """A slice of a larger batch gives what the rows alone give: shingles, tokens, toxicity's pieces and the cuts themselves."""
    texts = [None, "", "One two", "a B c d E f g", LONG, "x y Z é ÉCOLE ...", "tail of it"] * 3
    texts = [x for x in texts if nulls or x is not None]
    whole = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    pieces = tokens.Pieces(queries.tokenizer("word_bpe_49k.json"), False)
    parts = list(slices([whole], "text", 1000, 2))
    assert [x for p in parts for x in p.column("text").to_pylist()] == texts and len(parts) > 10
    for width in (1, 3, 5):
        got = [x.tolist() for p in parts for x in neardup.shingle_sets(p.column("text"), width)]
        alone = [neardup.shingle_sets(pa.array([x], pa.string()), width)[0].tolist() for x in texts]
        assert got == alone
        sizes = [len({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))}) if (w := ascii_words(x, r"[^\x20\x09-\x0D]+")) else 0 for x in texts]
        assert [len(x) for x in got] == sizes
    t = library("word_bpe_49k.json")
    assert [i for p in parts for i in pieces.texts(p.column("text")).flat.tolist()] == [i for x in texts for i in t.encode(x or "", add_special_tokens=False).ids]
    cut = []
    for p in parts:
        found, owner = toxicity.split(p.column("text"))
        cut += [[x for x, o in zip(found.to_pylist(), owner, strict=True) if o == k and x] for k in range(len(p.column("text")))]
    assert cut == [(x or "").split() for x in texts]


@pytest.mark.parametrize("width,num,den", [(3, 90, 100), (5, 8, 10)])
def test_ngram_jaccard_join(spark, docs, rows, width, num, den, monkeypatch):
    monkeypatch.setattr(neardup, "GROUP", 16)  # so that large blocks are cut
    more = near_copies(90, 1) + near_copies(40, 2, 30, 4) + near_copies(30, 3, 8, 2) + [(10**7 + k, f"same line again {k % 3}") for k in range(12)]
    every = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id bigint, text string"))
    got = neardup.near_duplicates(every, width, num, den).collect()
    want = brute_components([(i, x) for i, x, _ in rows] + more, width, num, den)
    assert bag((r.doc_id, r.n_shingles, r.component_id) for r in got) == bag(want)
    kept = [r.doc_id for r in neardup.keep_one(every, width, num, den).collect()]
    assert len(kept) == len({c for _, n, c in want if n}) + len({(i, x) for (i, x), (_, n, _) in zip([(i, x) for i, x, _ in rows] + more, want, strict=True) if not n})


@pytest.mark.parametrize("width,num,den,group", [(3, 90, 100, 16), (5, 8, 10, 16), (5, 8, 10, 256)])
def test_every_link_counts(spark, docs, rows, width, num, den, group, monkeypatch):
    monkeypatch.setattr(neardup, "GROUP", group)
    more = near_copies(60, 1) + near_copies(40, 2, 30, 4) + near_copies(30, 3, 8, 2) + [(10**7 + k, f"same line again {k % 3}") for k in range(12)]
    every = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id bigint, text string"))
    sets = []
    for i, text in [(i, x) for i, x, _ in rows] + more:
        w = ascii_words(text, r"[^\x20\x09-\x0D]+")
        sets.append((i, {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()))
    want = [(i, sum(bool(a and b) and den * len(a & b) >= num * len(a | b) for k, (_, b) in enumerate(sets) if k != n)) for n, (i, a) in enumerate(sets)]
    assert bag((r.doc_id, r.n_links) for r in neardup.near_duplicates(every, width, num, den).collect()) == bag(want)


def test_near_copies_of_nothing(docs):
    assert neardup.near_duplicates(docs.where("false")).collect() == []
    assert bag(r.n_shingles for r in neardup.near_duplicates(docs.where("text = ''")).collect()) == {0: 1}


def test_shards(docs, rows):
    got = shards.interleave(docs, 7).collect()
    assert bag((r.doc_id, r.size, r.text_crc32, r.source) for r in got) == bag((i, len((x or "").encode()) + 16, zlib.crc32((x or "").encode()), s) for i, x, s in rows)
    sizes = bag(r.shard for r in got)
    assert set(sizes) == set(range(7)) and max(sizes.values()) - min(sizes.values()) <= 1
    for k in range(7):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sizes[k]))
    for source, n in bag(s for _, _, s in rows).items():
        per = bag(r.shard for r in got if r.source == source)
        assert all(abs(per[k] - n / 7) <= 2 for k in range(7))
    by_source = collections.defaultdict(list)
    for i, x, s in rows:
        digest = hashlib.md5(("42" + (f":{i}" if i is not None else "")).encode()).hexdigest()
        by_source[s].append((int(digest[:10], 16), i, int(digest[10:20], 16)))
    order = sorted(((k + 1 - u / 2.0**40) / len(v), h, "" if s is None else f"={s}", -1 if i is None else i) for s, v in by_source.items() for k, (h, i, u) in enumerate(sorted(v, key=lambda z: (z[0], z[1] or -1))))
    assert [r.doc_id for r in sorted(got, key=lambda r: r.place)] == [None if x[3] == -1 else x[3] for x in order]
    assert shards.interleave(docs.where("false"), 3).collect() == []


def test_shards_of_many_sources(spark):
    """20,000 sources of one row each: none of the buckets that rows are ranked in has many of them, and shards share them out."""
    tail = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.col("id").cast("string").alias("source"))
    head = spark.range(20_000, 30_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.lit("host").alias("source"))
    got = shards.interleave(tail.unionByName(head), 10).groupBy("shard").agg(F.count("*").alias("n"), F.count_if(F.col("source") == "host").alias("hosts")).collect()
    assert [r.n for r in got] == [3000] * 10 and all(900 < r.hosts < 1100 for r in got)
    u = [int(hashlib.md5(f"42:{i}".encode()).hexdigest()[10:20], 16) / 2.0**40 for i in range(20_000)]
    buckets = bag(int((1 - x) * 173) for x in u)  # as many as the square root of the rows
    assert max(buckets.values()) < 200


def test_top_k(spark):
    random.seed(5)
    vectors = [(i, [random.gauss(0, 0.3) for _ in range(24)]) for i in range(600)] + [(700, None), (701, [1.0, float("nan")] + [0.0] * 22), (750, [float("inf")] * 24), (702, [None] + [0.0] * 23), (703, []), (800, [0.0] * 24), (801, [0.0] * 24), (850, [0.5] * 3), (851, [0.5] * 3)]
    df = spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>").withColumn("rank", F.lit("clash"))
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, 5, scale=256).collect()
    fine = {i: np.floor(256 * np.array(v, "float32").astype("float64")) for i, v in vectors if v and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q in fine:
        if q % 50 == 0:
            best = sorted((-int(fine[q] @ x), i) for i, x in fine.items() if i != q and len(x) == len(fine[q]))[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert bag((r.query_id, r.rank, r.vec_id, int(r.score)) for r in got) == bag(want)


def test_language(spark, docs):
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    profiles = language.fit_profiles(docs, ~held_out)
    assert set(profiles) == {"en", "fr", "de", "es"}
    got = language.predict_language(docs, profiles, ["doc_id", "lang", "text"]).collect()
    scored = [r for r in got if r.lang is not None and r.lang_pred != "und"]
    assert sum(r.lang == r.lang_pred for r in scored) >= 0.97 * len(scored)
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in got) and all(0 <= r.score <= 1 for r in got)
    a, b = language.grams("Ab b!")
    assert sum(b) == 3 + 5 + 3 and len(a) == len(set(a.tolist()))
    assert {r.lang_pred for r in language.predict_language(docs, {}, ["doc_id"]).collect()} == {"und"}


def brute_score(model, text):
    """The forward pass, word by word and n-gram by n-gram, with Python integers."""
    values = []
    for piece in re.split("[ \t-\r]+", text or ""):
        word = piece.lower().strip(toxicity.PUNCTUATION)
        if word:
            marked = f"<{word}>"
            grams = [(0, marked)] + [(n, marked[i : i + n]) for n in (3, 4, 5) for i in range(len(marked) - n + 1)]
            total = 0.0
            for n, gram in grams:
                code = 0
                for c in gram:
                    code = (code * 0x100000001B3 + ord(c)) % 2**64
                code = (code + (n << 56)) % 2**64
                code = (code ^ code >> 30) * 0xBF58476D1CE4E5B9 % 2**64
                code = (code ^ code >> 27) * 0x94D049BB133111EB % 2**64
                total += float(model.subword[(code ^ code >> 31) % toxicity.BUCKETS])
            values.append(total / len(grams))
    logit = model.bias + (sum(values) / len(values) if values else 0.0)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, logit))))


def test_toxicity(spark, docs, rows):
    random.seed(3)
    vocabulary = ["".join(random.choices("abcdefghij", k=5)) for _ in range(300)]
    texts = [(i, " ".join(random.choices(vocabulary, k=40) + (["horrible", "Dreadful!"] if i % 5 == 0 else []))) for i in range(600)]
    odd = [(9000, " ".join(vocabulary[:40] + ["horrlble", "dreadfull"])), (9001, None), (9002, ""), (9003, "..."), (9004, "ΟΔΟΣ, Straße <b>"), (None, texts[0][1])]
    df = spark.createDataFrame([*texts, *odd, texts[500], texts[500]], "doc_id bigint, text string").withColumn("score", F.lit("clash")).withColumn("row", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)] + [(0, 0), (None, 1), (7, None)], "doc_id bigint, toxic int")
    model = toxicity.fit_toxicity(df, labels)
    scored = toxicity.score_toxicity(df, model, ["doc_id", "text", "row"]).collect()
    assert len(scored) == 608 and all(math.isclose(r.score, brute_score(model, r.text), rel_tol=1e-6) for r in scored)
    got = {r.doc_id: r.score for r in scored}
    bad, fine = [got[i] for i in range(400, 600) if i % 5 == 0], [got[i] for i in range(400, 600) if i % 5]
    assert np.mean([x > y for x in bad for y in fine]) > 0.9
    assert got[9000] > np.median(fine)
    assert got[9001] == got[9002] == got[9003]
    long = toxicity.score_toxicity(docs, model, ["doc_id", "text"]).collect()
    assert all(math.isclose(r.score, brute_score(model, r.text), rel_tol=1e-6) for r in long) and len(long) == len(rows)
    assert toxicity.score_toxicity(df.where("false"), model, ["doc_id"]).collect() == []
    none = toxicity.fit_toxicity(df, labels.where("false"))
    assert none.bias < 0 and not none.subword.any() and not toxicity.fit_toxicity(df.where("false"), labels).subword.any()
    with pytest.raises(ValueError):
        toxicity.score_toxicity(df, model, ["score"])


def test_toxicity_gradients():
    """Against differences of the loss."""
    rng = np.random.default_rng(1)
    bag_of = toxicity.Rows(np.array([2, 1, 3]), np.array([0, 2, 3, 1, 2, 4]), np.array([0.5, 0.5, 1, 0.2, 0.3, 0.5]), 5)
    docs = toxicity.Rows(np.array([2, 1, 2]), np.array([0, 1, 2, 0, 2]), np.array([0.4, 0.6, 1, 0.7, 0.3]), 3)
    for x in (bag_of, docs):
        x.weights, x.back_weights = x.weights.astype("float64"), x.back_weights.astype("float64")
    labels = np.array([1.0, 0.0, 1.0])
    parts = [rng.normal(size=(5, 2)), rng.normal(size=(2, 1)), rng.normal(size=1)]
    _, grads = toxicity.gradients(docs, bag_of, labels, *parts, 2.0)
    for x, g in zip(parts, grads, strict=True):
        for at in np.ndindex(*x.shape):
            x[at] += 1e-6
            up = toxicity.gradients(docs, bag_of, labels, *parts, 2.0)[0]
            x[at] -= 2e-6
            down = toxicity.gradients(docs, bag_of, labels, *parts, 2.0)[0]
            x[at] += 1e-6
            assert math.isclose((up - down) / 2e-6, g[at], abs_tol=1e-7)


@pytest.mark.parametrize("leave_out", [True, False])
def test_lm_scores(docs, rows, leave_out, monkeypatch):
    """Against the formula of the docstring, token by token, with counts of tuples in dictionaries."""
    monkeypatch.setattr(lm, "BATCH_DOCS", 30)  # so that n-grams lie in several batches
    t = library("word_bpe_49k.json")
    more = [(3 * 10**6 + k, "a text that is there twice and nowhere else: zebra quince vortex") for k in range(2)]
    every = docs.select("doc_id", "text", "word").unionByName(docs.sparkSession.createDataFrame(more, "doc_id bigint, text string").withColumn("word", F.lit("clash")))
    texts = [(i, x) for i, x, _ in rows] + more
    ids = [t.encode(x or "", add_special_tokens=False).ids for _, x in texts]

    def grams(s):
        return bag(tuple(s[k : k + n]) for n in (1, 2, 3) for k in range(len(s) - n + 1))

    whole = sum(map(grams, ids), collections.Counter())
    total = sum(map(len, ids))
    want = []
    for (i, _), s in zip(texts, ids, strict=True):
        own = grams(s) if leave_out else collections.Counter()
        logs = []
        for k in range(len(s)):
            factor = 1.0
            for n in range(min(3, k + 1), 0, -1):
                gram = tuple(s[k - n + 1 : k + 1])
                count = whole[gram] - own[gram]
                if n == 1:
                    logs.append(math.log(factor * max(1, count) / max(1, total - (len(s) if leave_out else 0))))
                elif count:
                    logs.append(math.log(factor * count / (whole[gram[:-1]] - own[gram[:-1]])))
                    break
                factor *= 0.4
        want.append((str(i), len(logs), f"{sum(logs):.6g}" if logs else None))
    got = lm.lm_scores(every, queries.tokenizer("word_bpe_49k.json"), leave_out=leave_out).collect()
    assert bag((str(r.doc_id), r.n_scored, None if r.log_score is None else f"{r.log_score:.6g}") for r in got) == bag(want)
    assert all((r.lm_score is None) == (r.n_scored == 0) and (r.n_scored == 0 or math.isclose(r.lm_score, r.log_score / r.n_scored)) for r in got)
    if leave_out:
        twice, rest = [r.lm_score for r in got if r.doc_id in dict(more)], [r.lm_score for r in got if r.lm_score is not None and r.doc_id not in dict(more)]
        assert min(twice) > np.quantile(rest, 0.5)


def test_lm_scores_of_nothing(docs):
    assert lm.lm_scores(docs.where("false"), queries.tokenizer("word_bpe_49k.json")).collect() == []
    only = lm.lm_scores(docs.where("doc_id in (1000001, 1000002)"), queries.tokenizer("word_bpe_49k.json")).collect()
    assert [(r.n_scored, r.log_score, r.lm_score) for r in only] == [(0, None, None)] * 2


def test_a_batch_with_wide_keys():
    """Where a key and its place don't fit in one integer, another sort gives the same order."""
    keys = np.array([5, 1, 5, 0, 1])
    assert lm.in_order(keys, 5).tolist() == lm.in_order(keys, 1 << 62).tolist() == [3, 1, 4, 0, 2]
