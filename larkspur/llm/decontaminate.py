"""Benchmark decontamination: an inverted index of test items, queried by every passage of the training texts.

Items are cut into units of at most ``UNIT`` words. The index holds, for every word, its BM25 weight in each unit as a
share of the unit's score for its own text, and likewise in each item as a whole. Units lie in blocks, and
for every word and block the largest weight is kept.

A document is first queried as one passage of its words in runs that may be shingles: each word follows the one
before it in some item. Verification wants 0.8 of an item's shingles, so at most ``missing + 4`` of the item's words
can be absent from these runs: what the heaviest so many leave is the least share that an accepted document has, and
the item's threshold. The WAND test adds up a document's rare words and what the common ones could add at most, and
only pairs that can still reach the threshold are scored in full. No document that verification would accept is
skipped, wherever the item's parts lie in it.

Retrieved pairs, and no others, are verified by five-word shingles and by words of question and answer. Where scores
are asked for, passages of ``PASSAGE`` words of documents with a verified item are then scored by block-max WAND:
against the sum of their words' largest weights, against each block's sum, and in full only within blocks that can
reach ``RETRIEVE``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import cut_lineage, texts_of

#: Words of a unit at most, of a passage, and between passages: each run of UNIT words lies in some passage.
UNIT, PASSAGE, STRIDE = 64, 128, 64
#: Units of a block.
BLOCK = 8
K1, B = 1.2, 0.75
#: Share of a unit's own score from which a passage counts as the item's place.
RETRIEVE = 0.5
#: Words of a shingle; least share of an item's shingles, and of its question's and answer's words, in a text.
SHINGLE, OVERLAP, PART_OVERLAP = 5, 0.8, 0.5
#: A word of more than this share of the units is common: the WAND test counts it as if it were there.
COMMON = 0.05
#: Words of items that one index holds; a larger benchmark is searched in as many rounds as it takes.
INDEX_WORDS = 1_000_000
#: Words of documents handled together, cells of documents and items together, and rows unpacked together.
TOGETHER, CELLS, ROWS = 100_000, 4_000_000, 512

_BLANK = bytes(32 if not (48 <= i <= 57 or 97 <= i <= 122 or i >= 128) else i for i in range(256))
_EPS = 1e-9


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words in UTF-8; ASCII signs part words."""
    return (text or "").lower().encode("utf-8", "replace").translate(_BLANK).split()


def split_item(text: str) -> tuple[str, str]:
    """Question and answer: the answer is the last sentence, the question what precedes it; or all is question."""
    cut = [m.end() for m in re.finditer(r"[.!?]\s+", text.rstrip())]
    return (text[: cut[-1]], text[cut[-1] :]) if cut else (text, "")


@dataclass
class Item:
    item_id: int
    words: list[bytes]
    question: set[bytes]
    answer: set[bytes]
    shingles: set[bytes]

    def units(self) -> list[list[bytes]]:
        """The words in parts of like size, none above UNIT."""
        parts = -(-len(self.words) // UNIT)
        size = -(-len(self.words) // max(1, parts))
        return [self.words[at : at + size] for at in range(0, len(self.words), max(1, size))]

    def absent(self) -> int:
        """Different words that a text may lack at most if verification accepts it.

        A word with a place before the last four begins a shingle there, which must be missing; different words
        begin different shingles, so there are no more of them than missing shingles. Four words may stand in
        the last four places alone. Where no shingle may be missing, no word is.
        """
        missing = int(len(self.shingles) * (1 - OVERLAP) + _EPS)
        return missing + SHINGLE - 1 if missing else 0


def shingles_of(words: list[bytes]) -> set[bytes]:
    """Five-word shingles; fewer words are one shingle."""
    return {b" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))} if words else set()


def make_item(item_id: int, text: str) -> Item:
    question, answer = split_item(text)
    words = words_of(text)
    return Item(item_id, words, set(words_of(question)), set(words_of(answer)), shingles_of(words))


@dataclass
class Statistics:
    """Units of all items, their words, and the units that hold each word."""

    units: int
    words: int
    df: dict[bytes, int]


def statistics(items: list[Item]) -> Statistics:
    found = Statistics(0, 0, {})
    for item in items:
        for u in item.units():
            found.units, found.words = found.units + 1, found.words + len(u)
            for w in set(u):
                found.df[w] = found.df.get(w, 0) + 1
    return found


Rows = tuple[np.ndarray, np.ndarray, np.ndarray]


def _compressed(row: np.ndarray, column: np.ndarray, value: np.ndarray, rows: int, columns: int) -> Rows:
    """(start of each row, columns, largest value of each) of a sparse matrix."""
    key, at = np.unique(row * max(1, columns) + column, return_inverse=True)
    most = np.zeros(len(key))
    np.maximum.at(most, at, value)
    return np.searchsorted(key // max(1, columns), np.arange(rows + 1)), key % max(1, columns), most


def _spread(rows: Rows, wanted: np.ndarray, owner: np.ndarray) -> Rows:
    """Entries of the wanted rows, with the owner of each repeated for its entries."""
    start, column, value = rows
    n = start[wanted + 1] - start[wanted]
    at = np.repeat(start[wanted] - np.cumsum(n) + n, n) + np.arange(n.sum())
    return np.repeat(owner, n), column[at], value[at]


class Index:
    """Inverted index in compressed rows: of each word its units, blocks and items with weights; of each item its words.

    ``known`` has the statistics of all items where ``items`` are only some.
    """

    def __init__(self, items: list[Item], known: Statistics | None = None):
        self.items = [x for x in items if x.words]
        known = known or statistics(self.items)
        mean = known.words / max(1, known.units)
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for x in self.items for w in x.words}), 1)}
        terms = len(self.vocabulary) + 1
        term, unit, weight, self.item_of = [], [], [], []
        of, item, raw = [], [], []
        for k, x in enumerate(self.items):
            whole: dict[bytes, float] = {}
            for u in x.units():
                own = {}
                for w in set(u):
                    tf = u.count(w)
                    idf = np.log(1 + (known.units - known.df[w] + 0.5) / (known.df[w] + 0.5))
                    own[w] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(u) / mean))
                    whole[w] = whole.get(w, 0.0) + own[w]
                total = sum(own.values())
                term += [self.vocabulary[w] for w in own]
                unit += [len(self.item_of)] * len(own)
                weight += [v / total for v in own.values()]
                self.item_of.append(k)
            total = sum(whole.values())
            of += [self.vocabulary[w] for w in whole]
            item += [k] * len(whole)
            raw += [v / total for v in whole.values()]
        t, u, x = np.array(term, np.int64), np.array(unit, np.int64), np.array(weight)
        self.units, self.blocks = len(self.item_of), -(-len(self.item_of) // BLOCK)
        self.rows = _compressed(t, u, x, terms, self.units)
        self.block_rows = _compressed(t, u // BLOCK, x, terms, self.blocks)
        self.best = np.zeros(terms)
        np.maximum.at(self.best, t, x)
        self._whole_items(np.array(of, np.int64), np.array(item, np.int64), np.array(raw), terms, known)
        self._shingles()
        # Tasks receive numbers in place of the items' words and shingles.
        self.sizes = np.array([len(x.shingles) for x in self.items])
        self.items = [replace(x, words=[], shingles=set()) for x in self.items]

    def _whole_items(self, t: np.ndarray, i: np.ndarray, x: np.ndarray, terms: int, known: Statistics) -> None:
        """Thresholds of items, their words, and the rare words by which documents meet them."""
        n = len(self.items)
        self.item_rows = _compressed(i, t, x, n, terms)
        common = np.zeros(terms, bool)
        for w, code in self.vocabulary.items():
            common[code] = known.df[w] > max(COMMON * known.units, 2)
        self.need, self.rest = np.zeros(n), np.zeros(n)
        rare = np.zeros(len(self.item_rows[1]), bool)
        for k, own in enumerate(self.items):
            a, b = self.item_rows[0][k : k + 2]
            heavy = np.argsort(-self.item_rows[2][a:b], kind="stable")
            share = self.item_rows[2][a:b][heavy]
            # One word at least is there, whatever may be absent.
            self.need[k] = max(1.0 - share[: own.absent()].sum(), share[-1]) - _EPS
            # Common words are left to the bound, as long as a document must hold others too.
            light = common[self.item_rows[1][a:b][heavy]]
            for j in np.flatnonzero(light)[::-1]:
                if self.rest[k] + share[j] >= 0.7 * self.need[k]:
                    light[j] = False
                else:
                    self.rest[k] += share[j]
            rare[a:b][heavy[~light]] = True
        at = np.repeat(np.arange(n), np.diff(self.item_rows[0]))[rare]
        self.rare_rows = _compressed(self.item_rows[1][rare], at, self.item_rows[2][rare], terms, n)

    def _shingles(self) -> None:
        """For each length of shingles: a hash without collisions here, the words, and each item's own; and which words follow which."""
        self.grams = {}
        by_size: dict[int, list[tuple[tuple[int, ...], int]]] = {}
        for k, item in enumerate(self.items):
            for s in item.shingles:
                codes = tuple(self.vocabulary[w] for w in s.split(b" "))
                by_size.setdefault(len(codes), []).append((codes, k))
        for size, own in by_size.items():
            words, at = np.unique(np.array([c for c, _ in own], np.int64), axis=0, return_inverse=True)
            odd = 0x9E3779B97F4A7C15
            while True:
                mix = np.array([pow(odd, j, 1 << 64) for j in range(size)], np.uint64)
                h = self._hash(words, mix)
                order = np.argsort(h, kind="stable")
                if (np.diff(h[order]) > 0).all():
                    break
                odd = (odd * 5 + 2) % (1 << 64)
            place = np.empty(len(words), np.int64)
            place[order] = np.arange(len(words))
            held = _compressed(np.array([k for _, k in own], np.int64), place[at.reshape(-1)], np.ones(len(own)), len(self.items), len(words))
            self.grams[size] = (mix, h[order], words[order], held)
        # A hash table of flags: two pairs of words in one place only let a run too many pass.
        self.follow = np.zeros(1 << (8 * sum(len(words) for _, _, words, _ in self.grams.values())).bit_length(), bool)
        for size, (_, _, words, _) in self.grams.items():
            for j in range(size - 1):
                self.follow[self._slot(words[:, j], words[:, j + 1])] = True

    def _slot(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        # Not linear, as words that follow each other in the sorted vocabulary may do so in items too.
        h = (first.astype(np.uint64) << np.uint64(32)) + second.astype(np.uint64)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return (h >> np.uint64(32)) & np.uint64(len(self.follow) - 1)

    @staticmethod
    def _hash(words: np.ndarray, mix: np.ndarray) -> np.ndarray:
        out = np.zeros(len(words), np.uint64)
        for j, m in enumerate(mix):
            out += words[:, j].astype(np.uint64) * m
        return out

    def codes(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int32, len(words))

    def _starts(self, codes: np.ndarray, document: np.ndarray) -> dict[int, np.ndarray]:
        """For each length of shingles, the positions where a document may hold one."""
        at = np.flatnonzero((codes[:-1] > 0) & (codes[1:] > 0) & (document[:-1] == document[1:]))
        follows = np.zeros(max(0, len(codes) - 1), bool)
        follows[at] = self.follow[self._slot(codes[at], codes[at + 1])]
        out = {}
        for size, (_, _, words, _) in self.grams.items():
            n = max(0, len(codes) - size + 1)
            run = np.isin(codes, words[:, 0]) if size == 1 else follows[:n].copy()
            for j in range(1, size - 1):
                run &= follows[j : n + j]
            out[size] = np.flatnonzero(run)
        return out

    def reach(self, codes: np.ndarray, document: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, item) of all pairs where the document's runs reach the item's threshold.

        Codes of several documents stand side by side; ``document`` numbers each position's. A shingle that a
        document holds is such a run, so what runs lack of an item is no more than ``absent`` where it is verified.
        """
        terms, items = len(self.best), len(self.items)
        known = np.zeros(len(codes), bool)
        for size, at in self._starts(codes, document).items():
            for j in range(size):
                known[at + j] = True
        pairs = np.unique(document[known] * terms + codes[known])
        doc, term = pairs // terms, pairs % terms
        owner, item, weight = _spread(self.rare_rows, term, doc)
        cells, back = np.unique(owner * items + item, return_inverse=True)
        partial = np.bincount(back, weight, len(cells))
        open_cells = cells[partial >= (self.need - self.rest)[cells % items]]
        d, i = open_cells // items, open_cells % items
        good = self._share(pairs, d, i) >= self.need[i]
        return d[good], i[good]

    def _share(self, pairs: np.ndarray, d: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Share of each item that its document's words make up; ``pairs`` has documents and words as one sorted key."""
        own, t, share = _spread(self.item_rows, i, np.arange(len(i)))
        key = d[own] * len(self.best) + t
        at = np.minimum(np.searchsorted(pairs, key), max(0, len(pairs) - 1))
        there = pairs[at] == key if len(pairs) else np.zeros(len(key), bool)
        return np.bincount(own[there], share[there], len(i))

    def overlap(self, codes: np.ndarray, document: np.ndarray, d: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Share of the item's shingles in the document, for each pair (d, i); no other pair is counted."""
        starts, found = self._starts(codes, document), np.zeros(len(d))
        for size, (mix, hashes, words, held) in self.grams.items():
            window = codes[starts[size][:, None] + np.arange(size)].astype(np.int64)
            h = self._hash(window, mix)
            place = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            same = (hashes[place] == h) & (words[place] == window).all(axis=1)
            met = np.unique(document[starts[size][same]] * len(hashes) + place[same])
            pair, own, _ = _spread(held, i, np.arange(len(i)))
            key = d[pair] * len(hashes) + own
            if len(met):
                at = np.minimum(np.searchsorted(met, key), len(met) - 1)
                found += np.bincount(pair[met[at] == key], minlength=len(d))
        return found / self.sizes[i]

    def retrieve(self, codes: np.ndarray, document: np.ndarray) -> dict[tuple[int, int], float]:
        """Best share by (document, item) of all passages' hits; codes of several documents stand side by side.

        ``document`` numbers each position's document. A passage starts at every STRIDE-th word of a document and
        takes its next PASSAGE words; a word counts once in a passage.
        """
        known = np.flatnonzero(codes)
        if not len(known):
            return {}
        term, doc = codes[known].astype(np.int64), document[known]
        first = np.searchsorted(document, doc)
        place = known - first
        # A position lies in the passage that its stride starts and in those that started up to PASSAGE before.
        later = place // STRIDE
        lies = [(doc << 32) + later - back for back in range(PASSAGE // STRIDE)]
        keep = [later >= back for back in range(PASSAGE // STRIDE)]
        passage, at = np.concatenate([p[k] for p, k in zip(lies, keep, strict=True)]), np.concatenate([term[k] for k in keep])
        names, passage = np.unique(passage, return_inverse=True)
        # WAND's test on the sum of the words' largest weights, repeats included; then without them.
        able = np.bincount(passage, self.best[at], len(names)) >= RETRIEVE - _EPS
        some = able[passage]
        pairs = np.unique(passage[some] * len(self.best) + at[some])
        passage, at = pairs // len(self.best), pairs % len(self.best)
        able = np.bincount(passage, self.best[at], len(names)) >= RETRIEVE - _EPS
        passage, at = passage[able[passage]], at[able[passage]]
        # Block-max: blocks whose sum of largest weights reaches the threshold.
        owner, block, bound = _spread(self.block_rows, at, passage)
        cells, back = np.unique(owner * self.blocks + block, return_inverse=True)
        open_cells = cells[np.bincount(back, bound, len(cells)) >= RETRIEVE - _EPS]
        if not len(open_cells):
            return {}
        # Full scores within open blocks only.
        some = np.isin(passage, open_cells // self.blocks)
        owner, unit, weight = _spread(self.rows, at[some], passage[some])
        inside = np.isin(owner * self.blocks + unit // BLOCK, open_cells)
        hits, back = np.unique(owner[inside] * self.units + unit[inside], return_inverse=True)
        score = np.bincount(back, weight[inside], len(hits))
        best: dict[tuple[int, int], float] = {}
        for k in np.flatnonzero(score >= RETRIEVE - _EPS):
            pair = int(names[hits[k] // self.units] >> 32), self.item_of[int(hits[k] % self.units)]
            best[pair] = max(best.get(pair, 0.0), float(score[k]))
        return best

    def _group(self, texts: list[list[bytes]], passages: bool) -> list[tuple[int, int, float, float]]:
        codes = [self.codes(words) for words in texts]
        document = np.repeat(np.arange(len(texts)), [len(c) for c in codes])
        codes = np.concatenate(codes)
        d, i = self.reach(codes, document)
        some = np.zeros(len(texts), bool)
        some[d] = True
        at = some[document]
        share = self.overlap(codes[at], document[at], d, i)
        good = share >= OVERLAP - _EPS
        pairs = list(zip(d[good].tolist(), i[good].tolist(), share[good].tolist(), strict=True))
        words = {k: set(texts[k]) for k in {p[0] for p in pairs}}
        parts = lambda item: (p for p in (item.question, item.answer) if p)
        pairs = [p for p in pairs if all(len(part & words[p[0]]) >= PART_OVERLAP * len(part) for part in parts(self.items[p[1]]))]
        some[:] = False
        some[[p[0] for p in pairs]] = True
        at = some[document]
        codes, document = codes[at], document[at]
        best = self.retrieve(codes, document) if pairs and passages else {}
        words_there = np.unique(document[codes > 0] * len(self.best) + codes[codes > 0])
        whole = self._share(words_there, np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64))
        return [(k, self.items[i].item_id, best.get((k, i), float(w)), s) for (k, i, s), w in zip(pairs, whole, strict=True)]

    def search(self, texts: list[str | None], passages: bool = True) -> list[tuple[int, int, float, float]]:
        """(text's number, item id, share of the best passage, share of shingles) of all verified pairs.

        Where no passage reaches RETRIEVE, the item lies scattered, and the share is that of the whole text; likewise
        of all pairs if ``passages`` are not to be scored.
        """
        out: list[tuple[int, int, float, float]] = []
        at, most = 0, max(1, CELLS // max(1, len(self.items)))
        while self.items and at < len(texts):
            group, total = [], 0
            while at < len(texts) and len(group) < most and (total < TOGETHER or not group):
                group.append(words_of(texts[at]))
                total += len(group[-1])
                at += 1
            out += [(at - len(group) + k, *rest) for k, *rest in self._group(group, passages)]
        return out


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of ROWS rows, so that only so many texts are unpacked at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, units that hold it, 0) of a batch's items, and (null, units, words)."""
    for batch in batches:
        found = statistics([make_item(0, x) for x in texts_of(batch.column(0))])
        word, units, words = [*found.df, None], [*found.df.values(), found.units], [0] * len(found.df) + [found.words]
        yield pa.RecordBatch.from_arrays([pa.array(word, pa.binary()), pa.array(units, pa.int64()), pa.array(words, pa.int64())], ["word", "units", "words"])


def build_indexes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[Index]:
    """Indexes that together hold every item, each of some INDEX_WORDS words, so what tasks receive is bounded.

    The number of rounds follows from a count of the benchmark's characters; items are dealt by hash. Weights
    come from the counts of all items, so the rounds find what one index would.
    """
    items = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    rounds = -(-chars // (2 * INDEX_WORDS)) or 1
    if rounds == 1:
        yield Index([make_item(r["item_id"], r["text"]) for r in sorted(items.collect())])
        return
    counts = lambda of: of.select("text").mapInArrow(_word_counts, "word binary, units long, words long")
    known = cut_lineage(counts(items).groupBy("word").agg(F.sum("units").alias("units"), F.sum("words").alias("words")))
    total = known.where("word is null").first()
    for k in range(rounds):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(rounds)) == k)
        df = known.join(counts(own).select("word").distinct(), "word").select("word", "units").collect()
        yield Index([make_item(r["item_id"], r["text"]) for r in sorted(own.collect())], Statistics(total["units"], total["words"], {bytes(r["word"]): r["units"] for r in df}))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, item_id, score, overlap)`` of every document row and every item verified in it; no shuffle.

    Null and empty texts, null items and items without a word match nothing; items of fewer than five words
    are one shingle; very long texts are searched whole, wherever an item's parts lie; ties change nothing, as
    every verified pair is returned; repeated rows repeat their pairs; null document ids stay null; bytes that are
    no UTF-8 count as U+FFFD; empty tables give an empty result; other columns are not read.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = None
    for index in build_indexes(benchmark):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in _slices(batches):
                ids = batch.column(0).to_pylist()
                hits = [(ids[k], i, score, share) for k, i, score, share in index.search(texts_of(batch.column(1)))]
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
                columns = [pa.array([h[c] for h in hits], kind) for c, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "score", "overlap"])

        part = own.mapInArrow(run, "doc_id long, item_id long, score double, overlap double")
        found = part if found is None else found.union(cut_lineage(part))
    return found


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with their own columns, in which no item is verified; rows pass beside the search.

    Rows with null, empty or blank texts stay; very long texts are searched whole; each of repeated rows is
    judged alike; an empty table gives an empty one, an empty benchmark keeps all rows; columns may have any names.
    A benchmark of more than one round writes what is left after each further round to the shared folder.
    """
    names = docs.columns
    for k, index in enumerate(build_indexes(benchmark)):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in _slices(batches):
                leaked = {k for k, *_ in index.search(texts_of(batch.column(names.index(text_col))), passages=False)}
                yield batch.filter(pa.array([k not in leaked for k in range(batch.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
        docs = cut_lineage(docs) if k else docs
    return docs
