"""Token counts by a Viterbi pass that keeps counts, not paths.

An Aho-Corasick automaton lists every vocabulary piece that ends at each place of a string; the dynamic
programme carries the best score and its number of pieces. Pieces and scores are those of a SentencePiece
file, read as a unigram vocabulary, with that tokenizer's rules: spaces become ``▁``, one more stands in front;
control, byte and unknown entries are not matched; a character that no one-character piece covers may
stand alone at ten below the least score and counts as its UTF-8 bytes; at equal scores the piece that starts
first, the longest, stays. Scores are summed in double precision, where these sums of whole numbers are exact.

No piece has ``▁`` after another character, so the best path of a text is that of its parts side by side,
each a run of ``▁`` and what follows, and parts met before need no second pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import texts_of

MODEL = "piece_bpe_32k.model"
#: Parts whose count a Python worker remembers at most, and the longest that it remembers.
REMEMBERED, LONGEST = 600_000, 64
#: Rows unpacked together.
ROWS = 512


@lru_cache(maxsize=2)
def vocabulary(model: str = MODEL) -> dict[str, float]:
    """Score of each piece that takes part in matching."""
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    path = model if "/" in model else public_tokenizers.path(model)
    m = SentencePieceProcessor(model_file=path)
    ids = (i for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i)))
    pieces = {m.id_to_piece(i): m.get_score(i) for i in ids}
    if any("▁" in p.lstrip("▁") for p in pieces):
        raise ValueError("a piece has a space after another character")
    return pieces


class Parts(dict):
    """Number of pieces of ``▁`` and a word, by word."""

    def __init__(self, pieces: dict[str, float]):
        import ahocorasick

        super().__init__()
        self.automaton = ahocorasick.Automaton()
        for p, score in pieces.items():
            self.automaton.add_word(p, (len(p), score))
        self.automaton.make_automaton()
        self.unknown = min(pieces.values()) - 10

    def viterbi(self, s: str) -> int:
        low, unknown = float("-inf"), self.unknown
        score, count = [0.0] + [low] * len(s), [0] * (len(s) + 1)
        done = 0  # places up to here have met all pieces that end there
        single = False

        def close(end: int, single: bool) -> None:
            if not single and score[end - 1] + unknown > score[end]:
                score[end], count[end] = score[end - 1] + unknown, count[end - 1] + len(s[end - 1].encode("utf-8", "surrogatepass"))

        for last, (size, own) in self.automaton.iter(s):
            end = last + 1
            while done < last:
                done += 1
                close(done, single)
                single = False
            total = score[end - size] + own
            if total > score[end]:
                score[end], count[end] = total, count[end - size] + 1
            single = single or size == 1
        while done < len(s):
            done += 1
            close(done, single)
            single = False
        return count[len(s)]

    def __missing__(self, word: str) -> int:
        n = self.viterbi("▁" + word)
        if len(word) <= LONGEST and len(self) < REMEMBERED:
            self[word] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        words = text.split(" ")
        if "" not in words and "▁" not in text:
            return sum([self[w] for w in words])
        # Runs of spaces are one part with what follows them.
        total, run = 0, 0
        for w in text.replace(" ", "▁").split("▁"):
            if w:
                total += self[w] if not run else self.viterbi("▁" * (run + 1) + w)
                run = 0
            else:
                run += 1
        return total + (self.viterbi("▁" * run) if run else 0)


@lru_cache(maxsize=2)
def _parts(model: str) -> Parts:
    return Parts(vocabulary(model))


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """``(doc_id, n_tokens)`` for every row of ``docs``; map-side, no shuffle.

    A null or empty text has no tokens; a very long one is counted whole, a word at a time; ties go as the module
    says; repeated rows and null ids keep their rows; bytes that are no UTF-8 count as U+FFFD; an empty table gives
    an empty result; other columns are not read. ``model`` is a file's path, which must exist on the executors,
    or the name of a public vocabulary.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = _parts(model)
        for batch in batches:
            counts = pa.array([parts.count(x) for at in range(0, batch.num_rows, ROWS) for x in texts_of(batch.column(1).slice(at, ROWS))], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), counts], ["doc_id", "n_tokens"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, n_tokens long")
