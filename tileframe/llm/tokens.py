"""Token counts and ids by the tokenizers library, in Arrow functions.

Batches are cut by bytes of text. For tokenizers of the form of ``word_bpe_49k.json`` (white space dropped, lower case, pretokens cut
by WORD_PATTERN, word ends marked) texts are split at ASCII spaces, which no token crosses; the distinct pieces that a worker
doesn't remember are cut into pretokens, and the library encodes the distinct pretokens among them in large batches. For any other
tokenizer the library gets whole texts. NULL and empty texts have no tokens. Equal texts have equal counts; rows are
independent, so repeated ids and rows are kept as they are. An empty table gives no rows. Columns of the input that aren't asked for
are not read, whatever their names; ``out`` may not be one of ``id_cols``.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tileframe.llm.common import by_bytes, slices
from tileframe.llm.ragged import Lists, Memory, spaced

#: Bytes of text handled at a time, and characters given to the library at a time.
GROUP_BYTES = 4 << 20
BATCH_CHARS = 500_000
#: A piece without a space that is longer than this is cut at line ends too.
LONG_PIECE = 65_536
#: The published pattern of this kind of tokenizer (a fixed value).
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Code points below this lower without context, are their own NFC and have classes that have long been settled.
PLAIN = 0x180
SPACE, LETTER, NUMBER, OTHER = range(4)


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def is_word_bpe(path: str) -> bool:
    """Whether the file has the form that may be cut at spaces and into pretokens."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    steps = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
    cut = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    return (
        steps == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in cut] == ["Split", "ByteLevel"] and cut[0]["pattern"] == {"Regex": WORD_PATTERN} and cut[0]["invert"]
        and not cut[1]["add_prefix_space"] and spec["model"]["type"] == "BPE" and spec["model"]["end_of_word_suffix"] == "</w>" and not any(" " in x["content"] for x in spec["added_tokens"])
    )


class Pieces:
    """Ids of texts, or only how many there are."""

    def __init__(self, path: str, lengths_only: bool):
        self.tokenizer = load_tokenizer(path)
        self.empty = Lists(np.empty(0, "int64"), None if lengths_only else np.empty(0, "int32"))
        self.lengths_only = lengths_only
        self.word_bpe = is_word_bpe(path)
        if self.word_bpe:
            from tokenizers import pre_tokenizers

            self.bare = load_tokenizer(path)
            self.bare.normalizer = None
            self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            vocab = self.bare.get_vocab()
            self.ends = np.zeros(1 + max(vocab.values()), bool)
            self.ends[[i for x, i in vocab.items() if x.endswith("</w>")]] = True
            kinds = {"L": LETTER, "N": NUMBER}
            self.kind = np.array([SPACE if chr(c).isspace() and not 0x1C <= c <= 0x1F else kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(PLAIN)], "uint8")
            self.pieces, self.words = Memory(self.encode_pieces, self.empty), Memory(self.encode_words, self.empty)

    def whole(self, texts: list[str]) -> Lists:
        """By the library alone."""
        lengths, flat = [], [np.empty(0, "int32")]
        for batch in by_bytes(texts, BATCH_CHARS):
            for x in self.tokenizer.encode_batch_fast(batch, add_special_tokens=False):
                lengths.append(len(x))
                if not self.lengths_only:
                    flat.append(np.array(x.ids, "int32"))
        return Lists(np.array(lengths, "int64"), None if self.lengths_only else np.concatenate(flat))

    def encode_words(self, words: pa.Array) -> Lists:
        """Of distinct pretokens; each has one id that ends a word, its last."""
        lengths, flat = [np.empty(0, "int64")], [np.empty(0, "int32")]
        ends = np.cumsum(pc.binary_length(words).to_numpy())
        cuts = np.flatnonzero(np.diff(ends // BATCH_CHARS, prepend=0)).tolist()
        for start, stop in zip([0, *cuts], [*cuts, len(words)], strict=True):
            if start == stop:
                continue
            ids = np.array(self.bare.encode_batch_fast([spaced(words.slice(start, stop - start))], add_special_tokens=False)[0].ids, "int32")
            last = np.flatnonzero(self.ends[ids])
            if len(last) != stop - start:
                raise ValueError("the vocabulary doesn't mark the ends of words")
            lengths.append(np.diff(last, prepend=-1))
            flat.append(ids)
        return Lists(np.concatenate(lengths), None if self.lengths_only else np.concatenate(flat))

    def encode_pieces(self, pieces: pa.Array) -> Lists:
        """Of distinct pieces. Those with other than plain characters, special strings or great length go to the library as they are."""
        n, joined = len(pieces), spaced(pieces)
        points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        odd = (points >= PLAIN) | (points == 0x130)
        odd[:-1] |= (points[:-1] == ord("<")) & (points[1:] == ord("|"))
        strange = pc.binary_length(pieces).to_numpy() > LONG_PIECE
        strange[np.cumsum(points == 32)[odd]] = True
        if not strange.any():
            return self.plain(joined, n)
        # A line end is white space, which is dropped.
        parts = [x.split("\n") if len(x) > LONG_PIECE else [x] for x in pieces.filter(pa.array(strange)).to_pylist()]
        rest = self.whole([p for x in parts for p in x]).joined(np.repeat(np.arange(len(parts)), [len(x) for x in parts]), len(parts))
        held = pieces.filter(pa.array(~strange))
        both = (self.plain(spaced(held), len(held)) if len(held) else self.empty) + rest
        place = np.empty(n, "int64")
        place[np.concatenate([np.flatnonzero(~strange), np.flatnonzero(strange)])] = np.arange(n)
        return both.take(place)

    def plain(self, joined: str, n: int) -> Lists:
        """Of n pieces between single spaces."""
        joined = joined.lower()
        points = np.frombuffer(f" {joined} ".encode("utf-32-le"), "<u4")
        kind = self.kind[points]
        # A segment begins where the kind changes, at each digit and each white space character.
        begins = np.empty(len(points), bool)
        begins[0] = True
        begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER) | (kind[1:] == SPACE)
        marks = np.flatnonzero((points == ord("'")) & begins)
        if len(marks):
            after = points[np.minimum(marks[:, None] + [1, 2], len(points) - 1)]
            two = np.isin(after[:, 0], [ord(c) for c in "stmd"])
            three = ((after[:, 1] == ord("e")) & np.isin(after[:, 0], [ord("r"), ord("v")])) | ((after == ord("l")).all(1))
            for found, width in ((marks[two], 2), (marks[three & ~two], 3)):
                begins[found + 1] = False
                begins[found + width] = True
        at = np.flatnonzero(begins)
        starts = np.cumsum(1 + (points >= 0x80)) - 1 - (points >= 0x80)
        data = f" {joined} ".encode()
        offsets = np.append(starts[at], len(data)).astype("int64")
        segments = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        held = kind[at] != SPACE
        words = segments.filter(pa.array(held)).dictionary_encode()
        owner = (np.cumsum(points == 32) - 1)[at[held]]
        return self.words.get(words.dictionary).take(words.indices.to_numpy()).joined(owner, n)

    def texts(self, texts: pa.Array) -> Lists:
        """Of each text of an Arrow array; NULL counts as empty."""
        if not self.word_bpe:
            return self.whole([x or "" for x in texts.to_pylist()])
        cut = pc.split_pattern(texts.cast(pa.large_string()).fill_null(""), " ")
        coded = cut.flatten().dictionary_encode()
        found = self.pieces.get(coded.dictionary).take(coded.indices.to_numpy())
        return found.joined(np.repeat(np.arange(len(texts)), pc.list_value_length(cut).to_numpy()), len(texts))


_WORKER: dict[tuple[str, bool], Pieces] = {}


def worker_pieces(path: str, lengths_only: bool) -> Pieces:
    """One bounded memory for each worker process, kept between its tasks."""
    if (path, lengths_only) not in _WORKER:
        _WORKER[path, lengths_only] = Pieces(path, lengths_only)
    return _WORKER[path, lengths_only]


def counter(path: str, text_col: str, out: str) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = worker_pieces(path, True)
        for part in slices(batches, text_col, GROUP_BYTES):
            keep = [(n, part.column(n)) for n in part.schema.names if n != text_col]
            found = pa.array(pieces.texts(part.column(text_col)).lengths)
            yield pa.RecordBatch.from_arrays([x for _, x in keep] + [found], [n for n, _ in keep] + [out])

    return count


def count_tokens(df: DataFrame, tokenizer_path: str, id_cols: list[str], text_col: str = "text", out: str = "n_tokens") -> DataFrame:
    """id_cols and the number of tokens of each whole text. NULL text: 0. Other columns are not read."""
    if out in id_cols:
        raise ValueError(f"{out} is among id_cols: give the counts another name")
    picked = df.select(*id_cols, text_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields if f.name != text_col)
    return picked.mapInArrow(counter(tokenizer_path, text_col, out), f"{schema}, `{out}` bigint")
