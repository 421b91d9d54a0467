"""Packing token sequences into fixed windows, best fit decreasing.

Texts become token ids on the executors; documents longer than a window are first cut into full windows, and
what remains of each is placed, longest first, in the open window with the least room that suffices. A
segment tree indexed by remaining capacity finds it. A full window needs no placement and is numbered where it is
stored. The rest, at most one piece a document, is dealt to shards of bounded size, so windows are chosen
among thousands of documents, never in one task for all.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import cut_lineage, texts_of

WINDOW = 1024
#: Id that ends every document.
END_ID = 0
TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
#: Pieces that meet in one shard of the placement: so many and one for each partition of the stored pieces at most.
SHARD_PIECES = 8192
#: Words whose ids a Python worker remembers at most.
REMEMBERED = 600_000

_BROKEN = re.compile(r" (?=\s)| $")
_CUT = re.compile(r" (?=\S)")


class _Words(dict):
    """Ids, as packed unsigned 32-bit numbers, of what stands between two spaces, with the space before it.

    The vocabulary's pre-tokenizer starts a new piece at a space that precedes a non-blank, so ids of a text
    are those of its words side by side. Ids come from the rank file of the same vocabulary, which gives what
    ``tokenizers`` gives; a word with the special token's string goes to ``tokenizers`` itself.
    """

    def __init__(self, lead: str, encode, whole, special: str, first: _Words | None = None):
        super().__init__()
        self.lead, self.encode, self.whole, self.special = lead, encode, whole, special
        self.first = self if first is None else first
        self.mark = {c: array("I", encode(c)).tobytes() for c in ",.\n"}

    def __missing__(self, word: str) -> bytes:
        if self.special in word:
            return array("I", self.whole.encode(self.lead + word, add_special_tokens=False).ids).tobytes()
        lines = word.split("\n")
        if len(lines) > 1 and not any(x == "" or x[0].isspace() or x[-1].isspace() for x in lines):
            ids = self[lines[0]] + b"".join([self.mark["\n"] + self.first[x] for x in lines[1:]])
        elif len(word) > 1 and word[-1] in ",." and word[-2].isalpha():
            ids = self[word[:-1]] + self.mark[word[-1]]
        else:
            ids = array("I", self.encode(self.lead + word)).tobytes()
        if len(self) < REMEMBERED:
            self[word] = ids
        return ids


@lru_cache(maxsize=2)
def _vocabulary(tokenizer: str, ranks: str) -> tuple[_Words, _Words]:
    import base64

    import tiktoken
    from tokenizers import Tokenizer

    with open(public_tokenizers.path(ranks), "rb") as f:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
    whole = Tokenizer.from_file(public_tokenizers.path(tokenizer))
    first = _Words("", fast.encode_ordinary, whole, "<|endoftext|>")
    return first, _Words(" ", fast.encode_ordinary, whole, "<|endoftext|>", first)


def token_bytes(text: str | None, tokenizer: str = TOKENIZER, ranks: str = RANKS) -> bytes:
    """Little-endian unsigned 32-bit ids of a text, without the closing id."""
    if not text:
        return b""
    first, rest = _vocabulary(tokenizer, ranks)
    words = (_CUT if _BROKEN.search(text) else _SPACE).split(text)
    return first[words[0]] + b"".join([rest[w] for w in words[1:]])


class _Space:
    """``str.split`` on spaces under the name that patterns have."""

    @staticmethod
    def split(text: str) -> list[str]:
        return text.split(" ")


_SPACE = _Space()


def tokenize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``(doc_id, start, length, ids binary, doc_tokens)``: each document cut into full windows and a rest."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        close = array("I", [END_ID]).tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows: list[tuple] = []
                for doc, text in zip(part.column(0).to_pylist(), texts_of(part.column(1)), strict=True):
                    ids = token_bytes(text) + close
                    n = len(ids) // 4
                    rows += [(doc, s, min(window, n - s), ids[4 * s : 4 * (s + window)], n) for s in range(0, n, window)]
                doc, start, length, ids, total = zip(*rows, strict=True)
                long = pa.int64()
                yield pa.RecordBatch.from_arrays([pa.array(doc, long), pa.array(start, long), pa.array(length, long), pa.array(ids, pa.binary()), pa.array(total, long)], ["doc_id", "start", "length", "ids", "doc_tokens"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(cut, "doc_id long, start long, length long, ids binary, doc_tokens long")


class Room:
    """Open windows by remaining capacity, under a segment tree whose nodes count the windows below them."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.open = [0] * (2 * self.size)
        self.windows: list[list[int]] = [[] for _ in range(self.size)]

    def add(self, capacity: int, name: int) -> None:
        self.windows[capacity].append(name)
        self._count(capacity, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """Remove and return (capacity, name) of the tightest window with room for ``least``, or None."""
        node = least + self.size
        if not self.open[node]:
            while node > 1 and (node & 1 or not self.open[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node *= 2
                node += not self.open[node]
        capacity = node - self.size
        self._count(capacity, -1)
        return capacity, self.windows[capacity].pop()

    def _count(self, capacity: int, by: int) -> None:
        node = capacity + self.size
        while node:
            self.open[node] += by
            node >>= 1


def place(lengths: list[int], window: int = WINDOW) -> tuple[list[int], list[int]]:
    """Window number and offset of each piece, for lengths in decreasing order."""
    room, names, offsets, used = Room(window), [], [], 0
    for n in lengths:
        found = room.take(n) if n < window else None
        if found is None:
            found, used = (window, used), used + 1
        capacity, name = found
        names.append(name)
        offsets.append(window - capacity)
        if capacity > n:
            room.add(capacity - n, name)
    return names, offsets


def assign_windows(pieces: DataFrame, window: int = WINDOW, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``.

    The pieces are stored first, so that they are made once and the numbers given to them stay. Full windows keep
    their place; the others go to shards in turn, by their place in the store, so that repeated rows part as well.
    A shard packs its own in a fixed order: a retried task gives the same windows.
    """
    stored = cut_lineage(pieces)
    number = F.monotonically_increasing_id()
    full = stored.where(F.col("length") == window).select("*", (2 * number + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = stored.where(F.col("length") < window)
    shards = max(1, -(-rest.count() // shard_pieces))
    keys = [c for c in pieces.columns if c != "ids"]

    def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", *[c for c in keys if c != "length"]], ascending=[False, *[True] * (len(keys) - 1)], kind="stable")
        names, offsets = place(part["length"].tolist(), window)
        part["sequence_id"] = [2 * ((key[0] << 32) + n) for n in names]
        part["offset"] = offsets
        return part.drop(columns="shard")

    fields = ", ".join(f"{c} {t}" for c, t in pieces.dtypes)
    dealt = rest.withColumn("shard", F.pmod(number, F.lit(shards)).cast("long"))
    return full.union(dealt.groupBy("shard").applyInPandas(pack, f"{fields}, sequence_id long, offset long"))


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Pieces ``(doc_id, start, length, ids, doc_tokens, sequence_id, offset)`` of every document of ``docs``.

    Every id of a document, its closing id included, lies in exactly one piece. A null or empty text has
    the closing id alone. Very long texts are cut into full windows, which are neither collected nor shuffled. At equal
    lengths the smaller id is placed first. Repeated rows are packed as often as they stand; rows with a null id
    are packed too; bytes that are no UTF-8 count as U+FFFD; an empty table gives an empty result; other columns
    are not read.
    """
    return assign_windows(tokenize(docs, id_col, text_col, window), window)


def sequences(pieces: DataFrame, window: int = WINDOW, pad_id: int = END_ID) -> DataFrame:
    """``(sequence_id, ids array<long>, mask array<int>)``: the windows themselves, padded unless a power of two long."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
        now, parts = None, []
        for batch in batches:
            for name, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name != now and parts:
                    yield now, b"".join(parts)
                    parts = []
                now = name
                parts.append(ids)
        if parts:
            yield now, b"".join(parts)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, ids, mask = [], [], []

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(ids, pa.list_(pa.int64())), pa.array(mask, pa.list_(pa.int32()))], ["sequence_id", "ids", "mask"])
            for x in (names, ids, mask):
                x.clear()
            return out

        for name, raw in windows(batches):
            own = array("I", raw).tolist()
            pad = 0 if len(own) & (len(own) - 1) == 0 else window - len(own)
            names.append(name)
            ids.append(own + [pad_id] * pad)
            mask.append([1] * len(own) + [0] * pad)
            if len(names) == 256:
                yield flush()
        if names:
            yield flush()

    ordered = pieces.select("sequence_id", "offset", "ids").repartition("sequence_id").sortWithinPartitions("sequence_id", "offset")
    return ordered.select("sequence_id", "ids").mapInArrow(build, "sequence_id long, ids array<long>, mask array<int>")
