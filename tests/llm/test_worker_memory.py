"""What Python workers hold during a stage and keep after it: it counts beside the stages that follow."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tests.llm.test_text_operators import library
from tileframe.llm import bpe, neardup
from tileframe.llm.queries import tokenizer


class Here:
    """A table of one task that is worked on in this process."""

    schema = StructType([StructField("doc_id", LongType()), StructField("text", StringType())])

    def __init__(self, texts):
        self.batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):  # noqa: N802
        return [ids for batch in run(iter([self.batch])) for ids in batch.column("ids").to_pylist()]


def words(n):
    return [f"w{x:x}" for x in np.random.default_rng(5).integers(0, 1 << 40, n).tolist()]


def test_encoder_remembers_nothing_after_a_task():
    path = tokenizer("byte_bpe_50k.json")
    texts = ["the same words, again and again", None, "", " ".join(words(200)), "a" * 200 + " the same"]
    t = library("byte_bpe_50k.json")
    for _ in range(2):
        assert bpe.encode(Here(texts), path, ["doc_id"]) == [t.encode(x or "", add_special_tokens=False).ids for x in texts]
        assert not bpe.worker_bpe(path).known


def test_encoder_forgets_what_came_up_once(monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY_PIECES", 300)
    coder, t, most = bpe.PairIndexBpe(tokenizer("byte_bpe_50k.json")), library("byte_bpe_50k.json"), 0
    rare = words(2000)
    for at in range(0, len(rare), 50):
        text = "it is a long   way,\n it's 12 " + " ".join(rare[at : at + 50]) + " x" * 3 + "é" * 100
        [ids] = coder.texts([text])
        assert np.frombuffer(ids, "<i4").tolist() == t.encode(text, add_special_tokens=False).ids
        most = max(most, len(coder.known))
        assert at == 0 or {" is", " a"} <= coder.known.keys()
        assert max(map(len, coder.known)) <= bpe.MEMORY_CHARS
    assert most <= 300


def test_pairs_are_compared_in_little_memory():
    random = np.random.default_rng(7)
    common = random.integers(0, 1 << 63, 20_000).astype("uint64")
    sets = [np.unique(np.append(common[random.random(len(common)) < 0.97], random.integers(0, 1 << 63, 100 * k).astype("uint64"))) for k in range(24)]
    total = sum(x.nbytes for x in sets)
    tracemalloc.start()
    neardup.SignatureTree(sets)
    tree = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    both = neardup.overlaps(sets)
    overlap = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = np.array([[len(np.intersect1d(a, b, assume_unique=True)) for b in sets] for a in sets])
    assert (np.where(np.eye(24), want, both) == want).all()
    assert tree < total and overlap < 5 * total


def test_overlaps_of_few_shingles():
    sets = [np.array(x, "uint64") for x in ([1, 2], [3], [2, 5], [])]
    both = neardup.overlaps(sets)
    np.fill_diagonal(both, 0)
    assert both.tolist() == [[0, 0, 1, 0], [0, 0, 0, 0], [1, 0, 0, 0], [0, 0, 0, 0]]
    assert neardup.overlaps(sets[1:2]).tolist() == [[0]]
