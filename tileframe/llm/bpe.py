"""Byte-level BPE encoding and decoding by a pair occurrence index.

The vocabulary and merges come from a tokenizers ``.json`` file with a byte-level pre-tokenizer; its path is a parameter.
Within a task, the distinct pretokens of a group of texts are laid end to end as one list of symbols. The index maps each
adjacent pair to all its positions; ranks that occur are applied in ascending order, each to all its positions from left
to right, and the lists of the pairs that this makes or breaks are updated. Results per piece are remembered within a task.

NULL and empty texts have no ids and decode to an empty text. Strings of added tokens inside a text become their ids, as the
library does. Bytes that aren't UTF-8 decode to U+FFFD. Rows are independent: repeated rows give repeated results. An empty table gives
no rows. Columns that aren't asked for are not read; id_cols may not hold the names of results.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tileframe.llm.common import by_bytes, release, slices

#: The published pre-tokenizer pattern of byte-level BPE (a fixed value).
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """Fixed values of the published byte-level form: the printable letter that stands for each byte: itself for visible Latin-1 bytes, else the next from U+0100 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(others)) for b in range(256)]


#: Characters of text handled at a time.
GROUP_CHARS = 500_000
#: Distinct pieces and pretokens remembered by a task; when there are more, those stay that came up again. Longer ones aren't remembered.
MEMORY_PIECES = 200_000
MEMORY_CHARS = 64


def arrow_texts(batches: Iterator[pa.RecordBatch], text_col: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Arrow batches in slices of few bytes, with their texts; NULL becomes empty."""
    for part in slices(batches, text_col, GROUP_CHARS):
        yield part, [x or "" for x in part.column(text_col).to_pylist()]


class Memory(dict[str, bytes]):
    """The ids of pieces and pretokens; a pretoken has the same as a piece."""

    def __init__(self):
        super().__init__()
        self.again: set[str] = set()
        self.long: list[str] = []

    def missing(self, keys: set[str]) -> list[str]:
        """Those of the keys that are to be added; the others have come up again."""
        new = keys.difference(self)
        self.again |= keys - new
        self.long += [x for x in new if len(x) > MEMORY_CHARS]
        return list(new)

    def forget(self) -> None:
        """Long keys go; if there are too many, those that came up once, and all if the others are more than half."""
        for key in self.long:
            self.pop(key, None)
        self.long = []
        if len(self) > MEMORY_PIECES:
            stay = {x: self[x] for x in self.again if x in self}
            self.clear()
            self.again = set()
            if 2 * len(stay) <= MEMORY_PIECES:
                self.update(stay)


class PairIndexBpe:
    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        self.of_byte = np.array([vocab[x] for x in letters])
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.ranks[vocab[left], vocab[right]] = (rank, vocab[left + right])
        self.pairs = list(self.ranks)
        one = {vocab[x]: b for b, x in enumerate(letters)}
        self.byte_pair_rank = np.full((256, 256), -1, "int32")
        for (left, right), (rank, _) in self.ranks.items():
            if left in one and right in one:
                self.byte_pair_rank[one[left], one[right]] = rank
        byte_of = {x: b for b, x in enumerate(letters)}
        self.added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        size = 1 + max([*vocab.values(), *self.added.values()])
        self.bytes_of = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(byte_of[x] for x in token) if all(x in byte_of for x in token) else token.encode()
        for token, i in self.added.items():
            self.bytes_of[i] = token.encode()
        self.split_added = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.pretokens = regex.compile(PRETOKEN).findall
        self.known = Memory()

    def merge_all(self, words: list[str]) -> list[bytes]:
        """Ids of each pretoken as little-endian 32-bit bytes; the pair occurrence index covers them all."""
        ranks = self.ranks
        coded = [word.encode("utf-8", "surrogatepass") for word in words]
        flat = np.frombuffer(b"".join(coded), "uint8")
        ends = np.cumsum([len(x) for x in coded])
        last = ends - 1
        pair_ranks = np.full(len(flat), -1, "int64")
        pair_ranks[:-1] = self.byte_pair_rank[flat[:-1], flat[1:]]
        pair_ranks[last] = -1
        at = np.flatnonzero(pair_ranks >= 0)
        order = np.argsort(pair_ranks[at], kind="stable")
        found, starts = np.unique(pair_ranks[at][order], return_index=True)
        index: dict[int, list[int]] = {int(r): x.tolist() for r, x in zip(found, np.split(at[order], starts[1:]), strict=True)} if len(at) else {}
        symbols: list[int] = self.of_byte[flat].tolist()
        places = np.arange(len(flat))
        after_ = places + 1
        after_[last] = -1
        before_ = places - 1
        before_[ends - [len(x) for x in coded]] = -1
        after: list[int] = after_.tolist()
        before: list[int] = before_.tolist()
        active = list(index)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            left, right = self.pairs[rank]
            made = ranks[left, right][1]
            for i in sorted(index.pop(rank)):
                j = after[i]
                if j < 0 or symbols[i] != left or symbols[j] != right:
                    continue
                symbols[i] = made
                symbols[j] = -1
                after[i] = k = after[j]
                if k >= 0:
                    before[k] = i
                    hit = ranks.get((made, symbols[k]))
                    if hit is not None:
                        if hit[0] not in index:
                            index[hit[0]] = []
                            heapq.heappush(active, hit[0])
                        index[hit[0]].append(i)
                h = before[i]
                if h >= 0:
                    hit = ranks.get((symbols[h], made))
                    if hit is not None:
                        if hit[0] not in index:
                            index[hit[0]] = []
                            heapq.heappush(active, hit[0])
                        index[hit[0]].append(h)
        done = np.array(symbols, "<i4")
        left_over = done >= 0
        whole = done[left_over].tobytes()
        stops = (np.cumsum(left_over)[last] * 4).tolist()
        return [whole[x:y] for x, y in zip([0, *stops[:-1]], stops, strict=True)]

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        cut = [self.pretokens(piece) for piece in pieces]
        known = self.known
        new = known.missing(set().union(*cut))
        if new:
            known.update(zip(new, self.merge_all(new), strict=True))
        return [b"".join([known[x] for x in parts]) for parts in cut]

    @staticmethod
    def pieces(text: str) -> list[str]:
        """Parts that no pretoken crosses: cut before a single space that follows something other than white space."""
        first, *rest = text.split(" ")
        if not rest:
            return [first] if first else []
        parts = [first, *[" " + x for x in rest]]
        if "" in rest or not first or any(x[-1].isspace() for x in parts):  # runs of white space belong together
            whole, parts = parts, []
            for part in whole:
                if parts and (not parts[-1] or parts[-1][-1].isspace()):
                    parts[-1] += part
                else:
                    parts.append(part)
        return parts

    def texts(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian 32-bit bytes."""
        for group in by_bytes(texts, GROUP_CHARS):
            cut: list[list[str]] = []
            special: dict[int, list] = {}
            for n, text in enumerate(group):
                if self.split_added is not None and any(x in text for x in self.added):
                    special[n] = [self.added[x] if x in self.added else self.pieces(x) for x in self.split_added.split(text) if x]
                    cut.append([p for x in special[n] if isinstance(x, list) for p in x])
                else:
                    cut.append(self.pieces(text))
            known = self.known
            new = known.missing(set().union(*cut))
            known.update(zip(new, self.encode_pieces(new), strict=True))
            get = known.__getitem__
            for n, parts in enumerate(cut):
                if n in special:
                    yield b"".join(b"".join(map(get, x)) if isinstance(x, list) else np.array([x], "<i4").tobytes() for x in special[n])
                else:
                    yield b"".join(map(get, parts))
            known.forget()

    def decode(self, ids: np.ndarray) -> str:
        table = self.bytes_of
        return b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace")


_WORKER: dict[str, PairIndexBpe] = {}


def worker_bpe(path: str) -> PairIndexBpe:
    if path not in _WORKER:
        _WORKER[path] = PairIndexBpe(path)
    return _WORKER[path]


def _schema(df: DataFrame, without: str) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema.fields if f.name != without)


def encode(df: DataFrame, path: str, id_cols: list[str], text_col: str = "text", decoded: str | None = None) -> DataFrame:
    """id_cols, ``ids`` array<int>, and with ``decoded`` a column of that name: the ids decoded again."""
    if clash := {"ids", decoded} & {*id_cols}:
        raise ValueError(f"{sorted(clash)} are names of results: give them other names")
    picked = df.select(*id_cols, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(path)
        for part, texts in arrow_texts(batches, text_col):
            keep = [(n, part.column(n)) for n in part.schema.names if n != text_col]
            rows = list(bpe.texts(texts))
            offsets = np.cumsum([0, *[len(x) // 4 for x in rows]], dtype="int32")
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(rows), "<i4")))
            more = [pa.array([bpe.decode(np.frombuffer(x, "<i4")) for x in rows], pa.string())] if decoded else []
            yield pa.RecordBatch.from_arrays([x for _, x in keep] + [ids] + more, [n for n, _ in keep] + ["ids"] + ([decoded] if decoded else []))
            del part, texts, rows, ids, more, keep
        # The worker goes on to other stages, where what it remembers would count beside their own.
        bpe.known = Memory()
        release()

    return picked.mapInArrow(run, _schema(picked, text_col) + "ids array<int>" + (f", `{decoded}` string" if decoded else ""))


def decode(df: DataFrame, path: str, id_cols: list[str], ids_col: str = "ids", out: str = "text") -> DataFrame:
    """id_cols and the text of each list of ids. NULL or empty list: empty text."""
    picked = df.select(*id_cols, ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(path)
        for part in batches:
            keep = [(n, part.column(n)) for n in part.schema.names if n != ids_col]
            texts = pa.array([bpe.decode(np.array(x or [], "<i4")) for x in part.column(ids_col).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([x for _, x in keep] + [texts], [n for n, _ in keep] + [out])

    return picked.mapInArrow(run, _schema(picked, ids_col) + f"`{out}` string")
