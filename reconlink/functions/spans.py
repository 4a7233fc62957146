"""Spans: half-open [start, end) character offsets into the original text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from reconlink.functions.text import let, text

_OPEN, _CLOSE = "\u0001", "\u0002"
SPAN_TYPE = "array<struct<start:int,end:int,text:string>>"


# A fold copies its state at every step, so states are numbers or the short lists of one block.
_BLOCK = 64
_STRIDE = 32


def _blocks(items: Column, size: int = _BLOCK) -> Column:
    heads = F.filter(items, lambda _, i: i % size == 0)
    return F.transform(heads, lambda _, b: F.slice(items, b * size + 1, F.lit(size)))


def _running(values: Column, op: Callable[[Column, Column], Column], zero: Column, levels: int = 1) -> Column:
    """``op`` over each value and all before it: over what the blocks before hold, then over the own block."""

    def total(items: Column, start: Column) -> Column:
        return F.aggregate(items, start, op)

    def scanned(every: Column) -> Column:
        if levels == 0:
            return F.transform(every, lambda _, i: total(F.slice(every, F.lit(1), i + 1), zero))
        ahead = _running(F.transform(_blocks(every, _STRIDE), lambda b: total(b, zero)), op, zero, levels - 1)
        return let(ahead, lambda done: F.transform(every, lambda _, i: total(
            F.slice(every, i - i % _STRIDE + 1, i % _STRIDE + 1),
            F.coalesce(F.get(done, F.floor(i / _STRIDE).cast("int") - 1), zero))))

    return let(values, scanned)


def all_spans(value, pattern: str) -> Column:
    """array<struct<start,end,text>> of every match, left to right.

    Matches are fenced by control characters and the text is split at the fences:
    odd parts are the matches, and running totals of the part lengths place them.
    """
    plain = F.translate(F.coalesce(text(value), F.lit("")), _OPEN + _CLOSE, "  ")
    parts = F.split(F.regexp_replace(plain, pattern, f"{_OPEN}$0{_CLOSE}"), f"[{_OPEN}{_CLOSE}]", -1)

    def placed(p: Column) -> Column:
        sizes = F.transform(p["hits"], lambda hit, i: F.length(F.get(p["gaps"], i)) + F.length(hit))
        ends = _running(sizes, lambda total, size: total + size, F.lit(0))
        return let(ends, lambda end: F.transform(p["hits"], lambda hit, i: F.struct(
            (F.get(end, i) - F.length(hit)).alias("start"), F.get(end, i).alias("end"), hit.alias("text"))))

    sides = let(parts, lambda every: F.struct(
        F.filter(every, lambda _, i: i % 2 == 0).alias("gaps"), F.filter(every, lambda _, i: i % 2 == 1).alias("hits")))
    return let(sides, placed)


def first_span(value, pattern: str, group: int = 0) -> Column:
    """struct<start,end> of the first match, or NULL."""
    at = F.regexp_instr(text(value), F.lit(pattern))
    size = F.length(F.regexp_extract(text(value), pattern, group))
    return F.when(at > 0, F.struct((at - 1).alias("start"), (at - 1 + size).alias("end")))


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def span_length(span: Column) -> Column:
    return span["end"] - span["start"]


def greedy_spans(spans) -> Column:
    """Non-overlapping picks: earliest start first, longer first, skip what starts inside the last pick."""

    def ordered(items: Column) -> Column:
        return F.sort_array(F.transform(
            items, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("far"), s.alias("span"))))

    def step(state: Column, item: Column) -> Column:
        taken = item["start"] >= state["end"]
        return F.struct(
            F.when(taken, item["end"]).otherwise(state["end"]).alias("end"),
            F.when(taken, F.array_append(state["kept"], item["at"])).otherwise(state["kept"]).alias("kept"))

    def state(end: Column, kept: Column) -> Column:
        return F.struct(end.alias("end"), kept.alias("kept"))

    def pick(items: Column) -> Column:
        borders = F.transform(items, lambda x, i: F.struct(x["start"].alias("start"), x["span"]["end"].alias("end"), i.alias("at")))
        none = F.array().cast("array<int>")
        kept = F.aggregate(
            let(borders, lambda every: _blocks(every)), state(F.lit(0), F.array().cast("array<array<int>>")),
            lambda so_far, block: let(
                F.aggregate(block, state(so_far["end"], none), step),
                lambda got: state(got["end"], F.array_append(so_far["kept"], got["kept"]))),
            lambda s: F.flatten(s["kept"]))
        return F.transform(kept, lambda i: F.get(items, i)["span"])

    return let(ordered(text(spans)), pick)


def _heaps(items: Column) -> Column:
    """Spans in order of their start parted where none reaches over: only spans of one part can overlap."""
    ends = F.transform(items, lambda x: x["end"].cast("long"))
    reach = _running(ends, lambda a, b: F.greatest(a, b), F.lit(None).cast("long"))

    def parted(first: Column) -> Column:
        return F.transform(first, lambda at, j: F.slice(items, at + 1, F.coalesce(F.get(first, j + 1), F.size(items)) - at))

    def heads(reach: Column) -> Column:
        return F.filter(F.transform(items, lambda x, i: F.when(
            F.coalesce(x["start"] < F.get(reach, i - 1), F.lit(False)), -1).otherwise(i)), lambda i: i >= 0)

    return let(let(reach, heads), parted)


def merge_longer(primary, secondary) -> Column:
    """Add ``secondary`` spans to ``primary``: on overlap the longer one stays, a tie keeps the earlier.

    Spans that no chain of overlaps connects do not meet, so each connected heap is merged by itself.
    Only borders are moved about: ``slot`` is the place in the result, that of a primary span or behind
    them all in the secondary order, and ``pick`` the span that has it.
    """

    def row(span: Column, slot: Column, pick: Column) -> Column:
        return F.struct(slot.alias("slot"), span["start"].alias("start"), span["end"].alias("end"), pick.alias("pick"))

    def step(kept: Column, item: Column) -> Column:
        def place(at: Column) -> Column:
            longer = span_length(item) > span_length(F.try_element_at(kept, F.nullif(at, F.lit(0))))
            swapped = F.transform(kept, lambda k, i: F.when(i == at - 1, row(item, k["slot"], item["pick"])).otherwise(k))
            return F.when(at == 0, F.array_append(kept, item)).when(longer, swapped).otherwise(kept)

        return let(F.array_position(F.transform(kept, lambda k: overlaps(k, item)), True).cast("int"), place)

    def merged(heap: Column, first: Column) -> Column:
        folded = let(F.sort_array(heap), lambda r: F.aggregate(
            F.filter(r, lambda x: x["slot"] >= first), F.filter(r, lambda x: x["slot"] < first), step))
        return F.when(F.size(heap) > 1, folded).otherwise(heap)

    def whole(both: Column) -> Column:
        rows = F.transform(both["spans"], lambda s, i: F.struct(s["start"].alias("start"), row(s, i, i).alias("row")))
        heaps = let(F.transform(F.sort_array(rows), lambda x: x["row"]), _heaps)
        kept = F.flatten(F.transform(heaps, lambda heap: merged(heap, both["first"])))
        return F.transform(F.sort_array(kept), lambda x: F.get(both["spans"], x["pick"]))

    pair = F.struct(text(primary).alias("a"), text(secondary).alias("b"))
    return let(let(pair, lambda p: F.struct(F.concat(p["a"], p["b"]).alias("spans"), F.size(p["a"]).alias("first"))), whole)


def drop_overlapping(weak, strong) -> Column:
    """The weak spans that overlap no strong span."""
    return let(
        F.struct(text(weak).alias("weak"), text(strong).alias("strong")),
        lambda p: F.filter(p["weak"], lambda w: ~F.exists(p["strong"], lambda s: overlaps(w, s))),
    )


def clip_to_cells(spans, cells, joiner: str = " ") -> Column:
    """Spans of the joined cell text cut at the cell borders and rebased to each cell.

    array<struct<cell,start,end>>, cells counted from 0.
    """
    state = F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<start:int,end:int>>").alias("ranges"))

    def place(s: Column, cell: Column) -> Column:
        end = s["pos"] + F.length(F.coalesce(cell, F.lit("")))
        spot = F.struct(s["pos"].alias("start"), end.alias("end"))
        return F.struct((end + len(joiner)).alias("pos"), F.array_append(s["ranges"], spot).alias("ranges"))

    ranges = F.aggregate(text(cells), state, place, lambda s: s["ranges"])

    def clipped(items: Column, cell: Column, i: Column) -> Column:
        return F.transform(
            F.filter(items, lambda s: overlaps(s, cell)),
            lambda s: F.struct(
                i.cast("int").alias("cell"),
                (F.greatest(s["start"], cell["start"]) - cell["start"]).alias("start"),
                (F.least(s["end"], cell["end"]) - cell["start"]).alias("end"),
            ),
        )

    return let(text(spans), lambda items: F.flatten(F.transform(ranges, lambda c, i: clipped(items, c, i))))
