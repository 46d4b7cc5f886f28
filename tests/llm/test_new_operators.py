"""Vector codes, main text of pages and spelling variants against brute force, with awkward rows; bounds of what other operators gather."""

import collections
import hashlib
import html
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_text_operators import ODD, SF
from tileframe.llm import decontaminate, htmltext, lm, neardup, queries, toxicity, variants, vectorcodes

# Vector codes


def test_nearest_is_the_least_distance_and_then_index():
    r = np.random.default_rng(1)
    for length, k in itertools.product((1, 2, 3, 4, 5, 8, 12), (1, 2, 17, 64)):
        x, e = r.integers(-4, 4, (200, length)), r.integers(-4, 4, (k, length))
        d = ((x[:, None] - e) ** 2).sum(2)
        at, error = vectorcodes.nearest(vectorcodes.walsh_hadamard(x), vectorcodes.walsh_hadamard(e))
        assert (at == d.argmin(1)).all() and (error == d.min(1)).all()


def test_sequency():
    for n in (1, 2, 4, 8, 16):
        rows = vectorcodes.walsh_hadamard(np.eye(n, dtype="int64")).T
        assert [(a[1:] != a[:-1]).sum() for a in rows] == list(range(n)) and (rows @ rows.T == n * np.eye(n)).all()
    big = np.array([[1 << 20, -(1 << 20), 3]])
    assert int((vectorcodes.walsh_hadamard(big) ** 2).sum()) == 4 * int((big**2).sum())


def plain_codes(vectors, parts, entries, rounds, scale):
    """vectors: (id, vector, label), usable ones only."""
    x = [(i, [math.floor(scale * v) for v in vector], label) for i, vector, label in vectors]
    x.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    q = len(x[0][1]) // parts
    cut = [[v[p * q : (p + 1) * q] for p in range(parts)] for _, v, _ in x]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b, strict=True))
    near = lambda part, book: min(range(len(book)), key=lambda k: (far(part, book[k]), k))
    for _ in range(rounds):
        for p in range(parts):
            own = collections.defaultdict(list)
            for c in cut:
                own[near(c[p], books[p])].append(c[p])
            books[p] = [[sum(v) // len(own[k]) for v in zip(*own[k], strict=True)] if k in own else e for k, e in enumerate(books[p])]
    out = []
    for (i, _, label), c in zip(x, cut, strict=True):
        code = [near(c[p], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for k in code), sum(far(c[p], books[p][k]) for p, k in enumerate(code)), label))
    return out, hashlib.sha256(",".join(str(v) for book in books for e in book for v in e).encode()).hexdigest()


def test_vector_codes(spark):
    r = random.Random(2)
    fine = [(i if i != 70 else None, [r.gauss(0, 0.4) for _ in range(12)], None if i % 5 == 0 else i % 3) for i in range(120)]
    fine += [fine[3], (3, [0.5] * 12, 1), fine[9]]
    bad = [(200, None, 1), (201, [None] + [0.0] * 11, 1), (202, [float("nan")] * 12, 1), (203, [0.0] * 11 + [float("-inf")], 1), (204, [], 1), (205, [0.1] * 8, 1)]
    df = spark.createDataFrame(fine + bad, "vec_id bigint, embedding array<double>, label int").withColumns({"code": F.lit("taken"), "x": F.lit(1), "__sum": F.lit(2)}).repartition(4)
    books = vectorcodes.fit_codebooks(df, parts=4, entries=7, rounds=2, scale=256)
    coded = vectorcodes.encode(df, books, {"vec_id": F.col("vec_id"), "label": F.col("label")})
    got = vectorcodes.with_group_sum(coded, "label", "error", "label_error").collect()
    want, digest = plain_codes(fine, 4, 7, 2, 256)
    sums = collections.Counter()
    for _, _, error, label in want:
        sums[label] += error
    assert collections.Counter((g.vec_id, g.code, g.error, g.label, g.label_error) for g in got) == collections.Counter((*w, sums[w[3]]) for w in want)
    assert books.digest() == digest
    few = vectorcodes.fit_codebooks(df.where("vec_id < 3"), parts=4, entries=64)
    assert few.entries.shape == (4, 3, 3)
    with pytest.raises(ValueError):
        vectorcodes.encode(df, books, {"code": F.col("code")})
    with pytest.raises(ValueError):
        vectorcodes.fit_codebooks(df, parts=5)


def test_no_vectors(spark):
    none = spark.createDataFrame([(1, None, 2)], "vec_id bigint, embedding array<float>, label int")
    books = vectorcodes.fit_codebooks(none)
    assert books.digest() == hashlib.sha256(b"").hexdigest()
    assert vectorcodes.with_group_sum(vectorcodes.encode(none, books, {"vec_id": F.col("vec_id"), "label": F.col("label")}), "label", "error", "s").collect() == []


# Main text


def test_cut_is_minimal():
    r = random.Random(3)
    for _ in range(400):
        n = r.randint(0, 7)
        costs = [r.randint(-5, 5) for _ in range(n)]
        edges = [(a, b, r.randint(0, 4)) for a, b in itertools.combinations(range(n), 2) if r.random() < 0.5]
        cost = lambda s: sum(max(0, c) if not k else max(0, -c) for c, k in zip(costs, s, strict=True)) + sum(w for a, b, w in edges if s[a] != s[b])  # noqa: E731, B023
        got = htmltext.content_side(costs, edges)
        best = min(itertools.product([False, True], repeat=n), key=lambda s: (cost(s), sum(s)))
        assert cost(got) == cost(best) and sum(got) == sum(best)


BODY = """<div class="post-content"><header><h1>My title</h1></header><p>First paragraph here, with <a href=1>a link</a> &amp; more text in it.</p>
<div class="ad-slot">Buy now! It is the best offer in the world, really.</div><p>Short.</p><ul><li>one thing</li><li>another thing</li></ul>
<p>Second    paragraph\n of the text &eacute;t caetera.<aside>See also: all of our other stories on this.</aside></p><form><label>Name</label><input></form></div>"""
SITE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>x";</script></head><body class="has-sidebar"><header><h1>Site name</h1></header>
<nav><ul><li><a href=/>Home</a><li><a href=/b>News</a></ul></nav><div class="cookie-notice">We use cookies to make this site better. <button>OK</button></div>
<div class="wrap sidebar-left">%s</div><div class="sidebar"><p>About the author of this weblog, who wrote a lot of books and likes cats.</p></div>
<section id="comments"><article class="comment"><p>I think that this is wrong, as the author doesn't know.</p></article></section><footer>© 2020 All rights reserved by the site</footer></body></html>"""
TEXT = "My title\nFirst paragraph here, with a link & more text in it.\nShort.\none thing\nanother thing\nSecond paragraph of the text ét caetera."


def test_articles_without_what_surrounds_them():
    w = np.array(htmltext.WEIGHTS)
    assert htmltext.article_text(SITE % BODY, w) == TEXT
    assert htmltext.article_text(SITE % BODY.replace('<div class="post-content">', "<article>").replace("</form></div>", "</form></article>"), w) == TEXT
    assert htmltext.article_text(SITE % BODY.replace('<div class="post-content">', '<div role="main">'), w) == TEXT
    plain = BODY.replace(' class="post-content"', "").replace("<header>", "").replace("</header>", "")
    assert htmltext.article_text(SITE % plain, w) == TEXT


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("", ""), ("Hello world", "Hello world"), ("<b", ""), ("a<b>c", "ac"), ("x < y & z &am", "x < y & z &am"), ("<p>one<p>two<table><tr><td>a<td>b</table>", "one\ntwo\na\nb"),
        ("<article><p>one<br>two</p><p> </p><p>&nbsp;</p>three</article>", "one two\nthree"), ("<article><p>a<!-- <p>x</p> -->b</p><![CDATA[c]]></article>", "ab"),
        ("<article><p title='a>b'>x <i>y</i>z</p><textarea><p>no</p></textarea><p hidden>no</p><p style='display: none'>no</p></article>", "x yz"), ("<article><p>&lt;p&gt; &#x41;&#66;</p></article>", "<p> AB"),
    ],
)
def test_markup(source, text):
    assert htmltext.article_text(source, np.array(htmltext.WEIGHTS)) == text


def test_very_long_and_very_broken_pages():
    w = np.array(htmltext.WEIGHTS)
    many = "<article>" + "<p>A sentence of some words.</p>" * 20_000 + "</article>"
    assert htmltext.article_text(many, w).count("\n") == 19_999
    assert htmltext.article_text("<div>" * 20_000 + "deep down there is a text." + "</p>" * 20_000, w) == "deep down there is a text."
    assert htmltext.article_text('<a href="x' * 20_000, w) == "" and htmltext.article_text("<article>" + "word " * 200_000 + "</article>", w).count(" ") == 199_999


def test_page_table(spark):
    rows = [(1, "u", SITE % BODY), (1, "u", SITE % BODY), (2, None, None), (None, "v", ""), (3, "w", "<p>Some page of plain words without any article.")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({"text": F.lit("taken"), "k0": F.lit(1)})
    w = htmltext.fit_weights(df)
    got = htmltext.extract_text(df, w, ["page_id", "url", "k0"]).collect()
    assert collections.Counter((r.page_id, r.url, r.k0, r.text) for r in got) == collections.Counter([(1, "u", 1, TEXT)] * 2 + [(2, None, 1, ""), (None, "v", 1, ""), (3, "w", 1, "Some page of plain words without any article.")])
    none = df.where("false")
    assert tuple(htmltext.fit_weights(none)) == htmltext.WEIGHTS and htmltext.extract_text(none, w, ["page_id"]).collect() == []


def test_given_pages(spark):
    """The article element of each page, block by block."""
    given = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r.page_id: (r.text, r.n_chars) for r in queries.op12_html_text(spark, SF).collect()}
    for i, source in given.items():
        inner = re.sub(r"</?b>", "", re.search(r"<article>(.*)</article>", source, re.S)[1]).replace("<br>", " ")
        text = "\n".join(t for b in re.split(r"</?(?:h1|p)>", inner) if (t := " ".join(html.unescape(b).split())))
        assert got[i] == (text, len(text))


# Spelling variants


def edits(w, letters):
    cuts = [(w[:i], w[i:]) for i in range(len(w) + 1)]
    return {a + b[1:] for a, b in cuts if b} | {a + c + b for a, b in cuts for c in letters} | {a + c + b[1:] for a, b in cuts if b for c in letters} - {w}


def plain_variants(n, ratio=2):
    letters = {c for w in n for c in w}
    near = {w: sorted(edits(w, letters) & (n.keys() - {w})) for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


@pytest.mark.parametrize("limit", [2, 1024])
def test_variants(spark, limit):
    r = random.Random(4)
    n = {}
    for _ in range(60):
        w = "".join(r.choice("abé") for _ in range(r.randint(4, 9)))
        n[w] = r.choice((3, 50, 400))
        for _ in range(6):
            v = r.choice(sorted(edits(w, "abc")))
            n.setdefault(v, r.choice((3, 5, 20, 21)))
    n |= {"a" * 12: 5, "a" * 13: 10, "a" * 14: 20, "x" * 3000: 4, "x" * 3001: 9, "ab": 3, "b": 8, "c": 3}
    df = spark.createDataFrame(sorted(n.items()), "word string, n bigint").repartition(3)
    got = [(x.word, x.form, x.root, x.n, x.n_near, x.form_n) for x in variants.spelling_variants(df, limit=limit).collect()]
    assert len(got) == len(n) and set(got) == plain_variants(n)


def test_vocabulary(spark):
    docs = [(1, "Apple apple APPLE Äpfel-äpfel über ÜBERALL"), (1, "Apple apple APPLE Äpfel-äpfel über ÜBERALL"), (2, None), (None, "apple42apple d'apples"), (3, ""), (4, "z" * 50_000 + " naïve naïve naïve")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({"word": F.lit("x"), "n": F.lit(1), "w": F.lit(2), "h": F.lit(3)})
    for every in (None, 1, 3):
        want = collections.Counter()
        for i, text in docs:
            for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
                w = "".join(c.lower() if c < "\x80" else c for c in w)
                h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
                if every and h % every == 0:
                    w = w[: h % len(w)] + w[h % len(w) + 1 :]
                if len(w) >= 5:
                    want[w] += 1
        assert {r.word: r.n for r in variants.vocabulary(df, every=every, min_count=1).collect()} == want
        assert {r.word: r.n for r in variants.vocabulary(df, every=every).collect()} == {w: k for w, k in want.items() if k >= 3}
    assert variants.spelling_variants(variants.vocabulary(df.where("false"))).collect() == []


# What other operators gather


def test_one_text_an_id_teaches(spark):
    """Two labelled ids, one of which has many texts: the sample is two rows."""
    many = spark.range(3000).select(F.lit(1).cast("bigint").alias("doc_id"), F.concat(F.lit("text number "), F.col("id").cast("string")).alias("text"))
    docs = many.unionByName(spark.createDataFrame([(2, "some other words"), (2, "some other words"), (None, "no id")], "doc_id bigint, text string"))
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (None, 1), (9, 1)], "doc_id bigint, toxic int")
    rows = toxicity.sampled(docs, labels, "doc_id", "text", "toxic", 10).distinct().collect()
    assert len(rows) == 2 and sorted(r.y for r in rows) == [0, 1]
    assert len(toxicity.sampled(docs, labels, "doc_id", "text", "toxic", 1).distinct().collect()) == 1


def test_toxicity_is_told_apart(spark):
    """On rows that nothing was learned from."""
    sf = "/root/testdata/sf0.1"  # the smaller tables have too few labels to learn from
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.toxic is not None}
    scores = [(r.score, labels[r.doc_id]) for r in queries.op8_toxicity(spark, sf).where("held_out").collect() if r.doc_id in labels]
    pos, neg = [s for s, y in scores if y], [s for s, y in scores if not y]
    auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    assert len(pos) > 100 and auc > 0.9


def test_sparse_products():
    r = np.random.default_rng(5)
    lengths = r.integers(1, 6, 40)
    columns, weights = r.integers(0, 9, lengths.sum()), r.random(lengths.sum())
    dense, mean = np.zeros((40, 9)), np.zeros((40, 9))
    for row, (a, b) in enumerate(zip(np.cumsum(lengths) - lengths, np.cumsum(lengths), strict=True)):
        np.add.at(dense[row], columns[a:b], weights[a:b])
        np.add.at(mean[row], columns[a:b], 1 / lengths[row])
    x, g = r.random((9, 3)), r.random((40, 3))
    for piece in (1, 7, 1 << 18):
        toxicity.PIECE, old = piece, toxicity.PIECE
        try:
            for m, rows in ((dense, toxicity.Rows(lengths, columns, weights, 9)), (mean, toxicity.Rows(lengths, columns, None, 9))):
                assert np.allclose(rows.times(x), m @ x, atol=1e-6) and np.allclose(rows.back(g), (m.T @ g)[rows.used], atol=1e-6)
        finally:
            toxicity.PIECE = old


def test_a_window_of_many_items(spark):
    """A sentence that 3,000 items share: each document that has it meets all of them, at whatever places."""
    shared = "which of the following statements about the passage above is the most nearly correct"
    items = spark.range(3000).select(F.col("id").alias("item_id"), F.concat(F.lit(shared + " "), F.col("id").cast("string")).alias("text"))
    docs = spark.createDataFrame([(1, f"{shared}. {shared}!"), (2, f"so {shared} 17"), (3, "none of it"), (1, f"{shared}. {shared}!")], "doc_id bigint, text string")
    got = sorted((r.doc_id, r.n_hit, len(r.item_ids)) for r in decontaminate.contaminate(docs, items).collect())
    assert got == [(1, 28, 3000), (1, 28, 3000), (2, 15, 3000), (3, 0, 0)]


def test_keys_meet_in_pieces(spark, monkeypatch):
    """Buckets that are folded many times give the same components and links."""
    r = random.Random(6)
    texts = []
    for k in range(40):
        words = [f"w{r.randrange(4000)}" for _ in range(60)]
        for c in range(r.choice((1, 2, 5))):
            texts.append((len(texts), " ".join([*words[:-1], f"end{k}x{c}"])))
    df = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(6)
    whole = {(x.doc_id, x.component_id, x.n_links) for x in neardup.near_duplicates(df, 3, 90, 100).collect()}
    for name, n in (("BUCKET_KEYS", 50), ("FOLDED_KEYS", 60), ("HELD_KEYS", 100)):
        monkeypatch.setattr(neardup, name, n)
    assert {(x.doc_id, x.component_id, x.n_links) for x in neardup.near_duplicates(df, 3, 90, 100).collect()} == whole
    sets = {i: {tuple(t.split()[j : j + 3]) for j in range(len(t.split()) - 2)} for i, t in texts}
    links = {i: sum(j != i and 100 * len(a & b) >= 90 * len(a | b) for j, b in sets.items()) for i, a in sets.items()}
    assert {(i, n) for i, _, n in whole} == set(links.items())


def test_which_of_rows_with_one_id_and_text_stays(spark):
    rows = [(1, "same text of a few words here", "en", "b"), (1, "same text of a few words here", "de", "a"), (2, "something else that is long enough", None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    kept = {tuple(r) for r in neardup.keep_one(df).collect()}
    assert len(kept) == 2 and kept == {tuple(r) for r in neardup.keep_one(df.repartition(3, "lang")).collect()} and kept <= set(rows)


@pytest.mark.parametrize("leave_out", [True, False])
def test_scores_by_joins(spark, leave_out):
    """Count tables as rows give what packed counts give."""
    given = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(i if i is None else 10**6 + i, t) for i, t in ODD], "doc_id bigint, text string")
    docs, word = given.unionByName(odd).repartition(3), queries.tokenizer("word_bpe_49k.json")

    def rows(df):
        return sorted((r.doc_id is None, r.doc_id or 0, r.n_scored, 0.0 if r.log_score is None else r.log_score, r.lm_score is None) for r in df.collect())

    a, b = rows(lm.lm_scores(docs, word, leave_out=leave_out)), rows(lm.lm_scores_by_joins(docs, word, leave_out=leave_out))
    assert len(a) == len(b) and all(x[:3] == y[:3] and x[4] == y[4] and math.isclose(x[3], y[3], rel_tol=1e-9, abs_tol=1e-9) for x, y in zip(a, b, strict=True))
