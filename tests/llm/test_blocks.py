"""Blocks of sets that may link: no link is lost, and what only shares a passage doesn't chain into large blocks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tileframe.llm import neardup


@pytest.mark.parametrize(("num", "den"), [(8, 10), (90, 100), (7, 10)])
def test_linked_sets_share_a_key_whatever_is_common(num, den):
    r = np.random.default_rng(5)
    classes = neardup.Classes(num, den)
    for size in (1, 2, 3, 5, 9, 14, 30, 41, 77, 150, 400, 1100):
        for deal in range(6):
            a = r.integers(0, 2**64, size, "uint64")
            # As far apart as linked sets can be: some shingles left out, others put in.
            gone = 0
            while gone < size and num * (size + gone + 1) <= den * (size - gone - 1):
                gone += 1
            b = np.concatenate([a[gone:], r.integers(0, 2**64, gone, "uint64")]) if deal % 2 else a[: max(1, -(-size * num // den))]
            both = len(np.intersect1d(a, b))
            assert den * both >= num * (size + len(b) - both)
            if both == size == len(b):
                continue  # equal sets are one node
            every = classes.keys(a, deal)
            for common in (neardup.Ranks(every[:0]), neardup.Ranks(r.permutation(every)), neardup.Ranks(r.permutation(np.intersect1d(every, classes.keys(b, deal))))):
                met = np.intersect1d(classes.keys(np.sort(a), deal, None, common), classes.keys(np.sort(b), deal, None, common))
                assert classes.home(max(size, len(b))) in (met & np.uint64(255)).tolist()
            places = [{"class": c, "block": -7 - c, "chunks": 1} for c in classes.of(size)]
            other = [{"class": c, "block": -7 - c, "chunks": 1} for c in classes.of(len(b))]
            met = np.intersect1d(classes.keys(np.sort(a), deal, places, neardup.Ranks(every[:0])), classes.keys(np.sort(b), deal, other, neardup.Ranks(every[:0])))
            assert classes.home(max(size, len(b))) in (met & np.uint64(255)).tolist()


def test_fewer_keys_where_some_can_be_done_without():
    h = np.random.default_rng(1).integers(0, 2**64, 200, "uint64")
    classes = neardup.Classes(8, 10)
    every = classes.keys(h)
    kept = classes.keys(h, 0, None, neardup.Ranks(every[3:4]))
    assert len(kept) < len(every) and every[3] not in kept and set(kept) <= set(every)
    assert max((kept & np.uint64(255)).tolist().count(c) for c in classes.of(200)) <= max(classes.kept[c] for c in classes.of(200))


def test_a_shared_passage_makes_no_large_block(spark, monkeypatch):
    """400 texts share a third of their words and nothing else; some have near copies. A block of them all would send each set to all chunks."""
    r = random.Random(3)
    line = " ".join(f"licence{k}" for k in range(22))
    texts = [f"{' '.join(f'w{r.randrange(10**9)}' for _ in range(24))} {line} {' '.join(f'w{r.randrange(10**9)}' for _ in range(24))}" for _ in range(400)]
    copies = [t.replace("licence21", f"other{k}") for k, t in enumerate(texts[:20])]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts + copies)], "doc_id bigint, text string").repartition(4)
    monkeypatch.setattr(neardup, "GROUP", 16)
    seen, plain = {}, neardup.materialise

    def kept(df, name):
        seen[name] = plain(df, name)
        return seen[name]

    monkeypatch.setattr(neardup, "materialise", kept)
    got = {x.doc_id: (x.component_id, x.n_links) for x in neardup.near_duplicates(df).collect()}
    want = {k: (k % 400 if k >= 400 else k, int(k < 20 or k >= 400)) for k in range(420)}
    assert got == want
    members = seen["members"].select("node", F.inline("places"))
    assert members.agg(F.sum("chunks")).first()[0] <= 420
