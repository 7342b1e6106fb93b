"""Packing tokenised examples into sequences: vector bin packing with the dot-product heuristic.

A sequence is a bin with three limits that hold at once: tokens, segments
(examples or pieces of one) and loss-bearing tokens.  Of the waiting pieces
that fit, the one whose demand vector (tokens, 1, loss tokens, each as a
share of its limit) has the largest dot product with what the sequence has
left goes in next; ties go to the slot that comes first.  When no whole piece
fits, the piece whose beginning fits best is cut there, and its rest waits
again, so a sequence ends full unless segments or loss tokens run out.  Such
a sequence, and the last ones of a task, are shortened to a power of two,
which trains without padding; what was cut off waits again.

Every task packs its own partition while it reads it: nothing is shuffled,
at most ``POOL`` pieces of at most ``max_tokens`` ids wait at a time, and an
example longer than a sequence is cut into whole sequences as it is read.
Sequence ids are unique over tasks (task number in the high bits).  A task
that is run again gives the same pieces if its partition holds the same rows
in the same order, as that of a file scan does; write a shuffled input first.

Token ids are those of the library for the whole text.  Texts are looked up
in units of white space and what follows it: the split pattern of a
byte-level model never joins a character to the white space after it, nor a
letter to a punctuation mark, so units are encoded independently
(``units_are_independent`` checks the model's settings; for another model
whole texts are encoded).  A bounded cache of the worker remembers the ids of
words; a plain word is one pre-token and goes straight to the library's
merges, anything else through the whole library.

Defined results: a null or empty text is the end id alone; repeated rows are
examples of their own; a null id stays null; a null prompt is empty; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import json
import re
import struct
from collections.abc import Iterator
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType
from tokenizers import Tokenizer

POOL = 2048
CACHE = 1_500_000      # words a worker remembers, at about 200 bytes
MAX_UNIT = 48   # longer words are not remembered
CHUNK = 1 << 20
OUT_ROWS = 2048
#: Unicode White_Space, which \s of the models' split pattern stands for (Python's own \s holds four control characters more)
_W = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
#: white space and what follows it; a plain word ends before a punctuation mark, which the pattern never joins to it
_UNIT = re.compile(f"[{_W}]*[{_LETTER}]+(?=[.,;:!?])|[{_W}]*[^{_W}]+|[{_W}]+")
_PLAIN = re.compile(f"[{_LETTER}]+")
_MARKS = (".", ",", ";", ":", "!", "?")
_END = re.compile(f"(?<=[^{_W}])(?=[{_W}])")
_SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


class _Gap(Exception):
    """A space follows other white space, so that words between spaces are no units."""


def _byte_characters() -> dict[int, str]:
    """Byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for the characters from 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def units_are_independent(spec: dict) -> bool:
    """The model of this file splits at white space as ``_UNIT`` does: byte level with its usual pattern, no
    normaliser, no text around the input, and added tokens that hold no white space and reach for none."""
    pre = spec.get("pre_tokenizer") or {}
    return (spec.get("normalizer") is None and spec.get("post_processor") is None and pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True) and not pre.get("add_prefix_space")
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(f"[{_W}]", t["content"]) for t in spec["added_tokens"]))


class _Known(dict):
    """Ids by text, found when first asked for; bounded."""

    def __init__(self, find):
        super().__init__()
        self.find = find

    def __missing__(self, text: str) -> bytes:
        ids = self.find(text)
        if len(text) <= MAX_UNIT:
            if len(self) >= CACHE:
                self.clear()
            self[text] = ids
        return ids


class _Words(_Known):
    """Ids of a space and the word.  Most words are seen once: the plain ones take the shortest way."""

    def __init__(self, find, merge, space: str):
        super().__init__(find)
        self.merge, self.space = merge, space

    def __missing__(self, word: str) -> bytes:
        if not (word.isascii() and word.isalpha() and len(word) <= MAX_UNIT):
            return super().__missing__(word)
        if len(self) >= CACHE:
            self.clear()
        ids = [t.id for t in self.merge(self.space + word)]
        self[word] = out = _PACKED[len(ids)](*ids)
        return out


#: writers of n little-endian unsigned 32-bit integers, for words that are remembered
_PACKED = [struct.Struct(f"<{n}I").pack for n in range(MAX_UNIT + 2)]


class Ids:
    """Token ids of texts as little-endian unsigned 32-bit integers."""

    def __init__(self, spec: str):
        self.model = Tokenizer.from_str(spec)
        self.by_unit = units_are_independent(json.loads(spec))
        self.bytes = _byte_characters()
        self.space = self.bytes[ord(" ")]
        self.merge = self.model.model.tokenize
        self.words = _Words(self._after_space, self.merge, self.space)
        self.others = _Known(self._encode)

    def of(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_unit:
            return self._encode(text)
        return b"".join(map(self._chunk, _chunks(text)))

    def _encode(self, text: str) -> bytes:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _merged(self, word: str, before: str) -> bytes:
        """A plain word is one pre-token, with the space before it: straight to the library's merges."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.bytes)
        ids = [t.id for t in self.merge(before + word)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _after_space(self, word: str) -> bytes:
        if _PLAIN.fullmatch(word):
            return self._merged(word, self.space)
        if not word or word[-1] in _SPACES:
            raise _Gap
        if word[-1] in _MARKS and _PLAIN.fullmatch(word, 0, len(word) - 1):
            return self.words[word[:-1]] + self.others[word[-1]]
        return self._units(" " + word)

    def _chunk(self, text: str) -> bytes:
        body = text.rstrip(_SPACES)
        head, *words = body.split(" ")
        end = self.others[text[len(body):]] if len(body) < len(text) else b""
        try:
            if head and head[-1] in _SPACES:
                raise _Gap
            return self._units(head) + b"".join(map(self.words.__getitem__, words)) + end
        except _Gap:
            return self._units(body) + end

    def _units(self, text: str) -> bytes:
        return b"".join(map(self._unit, _UNIT.findall(text)))

    def _unit(self, unit: str) -> bytes:
        plain = _PLAIN.fullmatch(unit, 1)
        if plain and unit[0] == " ":
            return self.words[unit[1:]]
        if plain and unit[0] == "\n":
            return self.others["\n"] + self._merged(unit[1:], "")
        return self.others[unit]


def _chunks(text: str) -> Iterator[str]:
    """Stretches of at least ``CHUNK`` characters that end where a unit ends."""
    at = 0
    while len(text) - at > CHUNK and (m := _END.search(text, at + CHUNK)):
        yield text[at:m.start()]
        at = m.start()
    yield text[at:] if at else text


@functools.lru_cache(maxsize=2)
def _reader(spec: str) -> Ids:
    return Ids(spec)


class Piece(NamedTuple):
    example: Any        # id of the example
    start: int          # its ids before this piece
    ids: bytes
    silent: int         # leading ids of the piece that bear no loss
    total: int          # ids of the example

    @property
    def length(self) -> int:
        return len(self.ids) >> 2

    @property
    def loss(self) -> int:
        return self.length - self.silent

    def cut(self, at: int) -> tuple[Piece, Piece]:
        return (self._replace(ids=self.ids[:4 * at], silent=min(self.silent, at)),
                self._replace(ids=self.ids[4 * at:], start=self.start + at, silent=max(self.silent - at, 0)))


class Packer:
    """Waiting pieces and the sequences made of them."""

    def __init__(self, max_tokens: int, max_segments: int, max_loss: int, pool: int = POOL):
        self.limits = np.array([max_tokens, max_segments, max_loss], float)
        self.max_tokens, self.max_segments, self.max_loss, self.pool = max_tokens, max_segments, max_loss, pool
        self.waiting: list[Piece | None] = []
        self.free: list[int] = []
        self.length, self.silent = np.zeros(pool, np.int64), np.zeros(pool, np.int64)

    def __len__(self) -> int:
        return len(self.waiting) - len(self.free)

    def _put(self, piece: Piece) -> None:
        if self.free:
            i = self.free.pop()
            self.waiting[i] = piece
        else:
            i = len(self.waiting)
            self.waiting.append(piece)
            if i == len(self.length):
                self.length, self.silent = (np.concatenate([a, np.zeros_like(a)]) for a in (self.length, self.silent))
        self.length[i], self.silent[i] = piece.length, piece.silent

    def _take(self, i: int) -> Piece:
        piece, self.waiting[i], self.length[i] = self.waiting[i], None, 0
        self.free.append(i)
        return piece

    def _best(self, left: np.ndarray, tokens: np.ndarray, loss: np.ndarray, allowed: np.ndarray) -> int:
        weight = left / self.limits / self.limits
        score = np.where(allowed, tokens * weight[0] + weight[1] + loss * weight[2], -1.0)
        i = int(score.argmax()) if len(score) else 0
        return i if len(score) and score[i] >= 0 else -1

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        """Take an example in; yields the sequences that are ready."""
        while piece.length:
            n = min(piece.length, self.max_tokens, piece.silent + self.max_loss)
            head, piece = piece.cut(n)
            if n == self.max_tokens:
                yield [head]
            else:
                self._put(head)
        while len(self) >= self.pool:
            yield self._sequence()

    def rest(self) -> Iterator[list[Piece]]:
        while len(self):
            yield self._sequence()

    def _sequence(self) -> list[Piece]:
        made, left = [], self.limits.copy()
        while left[0] and left[1] and len(self):
            length, silent = self.length[:len(self.waiting)], self.silent[:len(self.waiting)]
            loss = length - silent
            i = self._best(left, length, loss, (length > 0) & (length <= left[0]) & (loss <= left[2]))
            if i >= 0:
                piece = self._take(i)
            else:
                part = np.minimum(np.minimum(length, int(left[0])), silent + int(left[2]))
                i = self._best(left, part, np.maximum(part - silent, 0), (length > 0) & (part > 0))
                if i < 0:
                    break
                piece, later = self._take(i).cut(int(part[i]))
                self._put(later)
            made.append(piece)
            left -= (piece.length, 1, piece.loss)
        self._shorten(made)
        return made

    def _shorten(self, made: list[Piece]) -> None:
        """To a power of two, unless full."""
        n = sum(p.length for p in made)
        excess = 0 if n == self.max_tokens else n - (1 << (n.bit_length() - 1))
        while excess:
            last = made.pop()
            if last.length > excess:
                last, later = last.cut(last.length - excess)
                made.append(last)
                last = later
            self._put(last)
            excess -= last.length


def pack(examples: DataFrame, tokenizer_json: str, *, id_col: str = "doc_id", text: str = "text", prompt: str | None = None,
         end_id: int = 1, max_tokens: int = 2048, max_segments: int = 128, max_loss: int = 2048) -> DataFrame:
    """(id_col, start, length, loss_tokens, ids, doc_tokens, sequence_id, offset) per piece.

    The ids of an example are those of ``prompt`` (which bear no loss), those
    of ``text`` and ``end_id``; ``ids`` holds a piece's as little-endian
    unsigned 32-bit integers.  The tokenizer file is read on the driver and
    sent by value.
    """
    with open(tokenizer_json, encoding="utf-8") as f:
        spec = examples.sparkSession.sparkContext.broadcast(f.read())
    end = np.array([end_id], "<u4").tobytes()
    # names that cannot clash with the id column
    rows = examples.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"),
                           (F.col(prompt) if prompt else F.lit(None).cast("string")).alias("_prompt"))
    counts = ["start", "length", "loss_tokens", "doc_tokens", "sequence_id", "offset"]
    id_field = StructField("_id", examples.schema[id_col].dataType)
    schema = StructType([id_field, *[StructField(c, LongType()) for c in counts], StructField("ids", BinaryType())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, packer = _reader(spec.value), Packer(max_tokens, max_segments, max_loss)
        number, out, id_type = TaskContext.get().partitionId() << 33, [], None

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out))
            out.clear()
            arrays = [pa.array(columns[0], id_type), *[pa.array(c, pa.int64()) for c in columns[1:-1]], pa.array(columns[-1], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, ["_id", *counts, "ids"])

        def write(sequence: list[Piece]) -> None:
            nonlocal number
            at = 0
            for p in sequence:
                out.append((p.example, p.start, p.length, p.loss, p.total, number, at, p.ids))
                at += p.length
            number += 1

        for batch in batches:
            id_type = batch.schema.field(0).type
            for i in range(batch.num_rows):
                silent = reader.of(batch.column(2)[i].as_py())
                ids = silent + reader.of(batch.column(1)[i].as_py()) + end
                for sequence in packer.add(Piece(batch.column(0)[i].as_py(), 0, ids, len(silent) >> 2, len(ids) >> 2)):
                    write(sequence)
                    if len(out) >= OUT_ROWS:
                        yield flush()
        for sequence in packer.rest():
            write(sequence)
            if len(out) >= OUT_ROWS:
                yield flush()
        if out:
            yield flush()

    return rows.mapInArrow(task, schema).withColumnRenamed("_id", id_col)
