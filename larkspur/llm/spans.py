"""Positions of regular-expression matches, and texts cut at positions, as Spark expressions.

Spark returns the text of matches, not their places; the places follow from the lengths of the matches and
of the gaps that ``split`` leaves between them. Both walk the same leftmost, non-overlapping matches. Running
sums are taken by doubling steps, and texts are cut by way of short blocks, so that a text with very many matches
costs little more than a matter of its length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<start:bigint,end:bigint,hit:string,part:string>>"
#: Code points of a block.
BLOCK = 256
_STEPS = [1 << k for k in range(31)]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: inside a lambda, Spark computes an expression at every use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Running results of an associative ``join`` over an array of longs: each step joins twice as far back."""

    def double(known: Column, step: Column) -> Column:
        return F.transform(known, lambda x, i: F.when(i >= step, join(F.get(known, i - step), x)).otherwise(x))

    return let(values, lambda v: F.aggregate(F.filter(F.lit(_STEPS), lambda s: s < F.size(v)), v, double))


def add(a: Column, b: Column) -> Column:
    return a + b


def find_spans(text: Column, pattern: str, group: int = 0) -> Column:
    """Array of (start, end, hit, part) of all matches; code points, end exclusive; part is ``group``'s text.

    A text without a match is searched once; one with matches three times.
    """
    regex = F.lit(pattern)
    hits = F.regexp_extract_all(text, regex, F.lit(0))
    parts = F.regexp_extract_all(text, regex, F.lit(group)) if group else hits
    steps = F.filter(F.arrays_zip(F.split(text, pattern, -1).alias("gap"), hits.alias("hit"), parts.alias("part")), lambda x: x["hit"].isNotNull())

    def place(known: Column) -> Column:
        ends = running(F.transform(known, lambda x: (F.length(x["gap"]) + F.length(x["hit"])).cast("bigint")), add)
        return F.zip_with(known, ends, lambda x, end: F.struct((end - F.length(x["hit"])).alias("start"), end.alias("end"), x["hit"].alias("hit"), x["part"].alias("part")))

    return F.when(text.rlike(pattern), let(steps, place)).otherwise(F.array().cast(SPANS))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined; the empty string for no span."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def blocks_of(text: Column) -> Column:
    """The text in blocks of BLOCK code points, for ``cut``."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def cut(blocks: Column, start: Column, end: Column) -> Column:
    """The text's part from ``start`` to ``end``, reading no more than the blocks that hold it."""
    first = F.floor(start / BLOCK).cast("int")
    size = F.greatest(F.floor((end - 1) / BLOCK).cast("int") - first + 1, F.lit(0))
    joined = F.array_join(F.slice(blocks, first + 1, size), "")
    return F.substring(joined, (start - first * BLOCK + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int"))


def replace_spans(text: Column, spans: Column) -> Column:
    """``text`` with sorted spans (start, end, kind) replaced by their kinds in brackets.

    Of spans that overlap, the first is shown and all are taken out.
    """

    def fill(known: Column) -> Column:
        reached = lambda spans: running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))

        def show(both: Column) -> Column:
            spans, ends, blocks = both["spans"], both["ends"], both["blocks"]

            def piece(s: Column, i: Column) -> Column:
                before = F.coalesce(F.get(ends, i - 1), F.lit(0).cast("bigint"))
                return F.when(s["start"] >= before, F.concat(cut(blocks, before, s["start"]), F.lit("["), s["kind"], F.lit("]"))).otherwise("")

            last = F.element_at(ends, -1)
            return F.concat(F.array_join(F.transform(spans, piece), ""), cut(blocks, last, F.greatest(F.size(blocks).cast("bigint") * BLOCK, last)))

        return let(F.struct(known.alias("spans"), reached(known).alias("ends"), blocks_of(text).alias("blocks")), show)

    return F.when(F.size(spans) > 0, let(spans, fill)).otherwise(text)


def free_of(spans: Column, others: Column) -> Column:
    """``spans`` (start, end, ...) that overlap none of ``others`` (start, end); in the order of their starts.

    Both are sorted together; the others' farthest end so far and nearest start to come tell overlaps.
    """
    far = F.lit((1 << 62)).cast("bigint")

    def judge(events: Column) -> Column:
        ends = running(F.transform(events, lambda e: F.when(e["of"] == 0, e["end"]).otherwise(F.lit(0).cast("bigint"))), lambda a, b: F.greatest(a, b))
        starts = F.reverse(running(F.reverse(F.transform(events, lambda e: F.when(e["of"] == 0, e["start"]).otherwise(far))), lambda a, b: F.least(a, b)))

        def keep(both: Column) -> Column:
            marked = F.zip_with(both["events"], F.arrays_zip(both["ends"].alias("a"), both["starts"].alias("b")), lambda e, x: F.struct(e.alias("e"), x.alias("x")))
            good = F.filter(marked, lambda m: (m["e"]["of"] == 1) & (m["x"]["a"] <= m["e"]["start"]) & (m["x"]["b"] >= m["e"]["end"]))
            return F.transform(good, lambda m: m["e"]["span"])

        return let(F.struct(events.alias("events"), ends.alias("ends"), starts.alias("starts")), keep)

    def meet(own: Column) -> Column:
        mark = lambda c, of, span: F.transform(c, lambda s: F.struct(s["start"].alias("start"), F.lit(of).alias("of"), s["end"].alias("end"), span(s).alias("span")))
        nothing = F.get(own, F.lit(-1))
        return let(F.array_sort(F.concat(mark(others, 0, lambda s: nothing), mark(own, 1, lambda s: s)), lambda x, y: F.when(x["start"] != y["start"], F.when(x["start"] < y["start"], -1).otherwise(1)).otherwise(x["of"] - y["of"])), judge)

    return F.when(F.size(spans) > 0, let(spans, meet)).otherwise(spans)
