"""What the two substring operators share: finding where windows of a text can recur, and judging it.

A window is ``window`` consecutive units (bytes or words) of one text.  Its anchor is the least hash of
the strings of ``anchor`` units inside it.  Equal windows have equal anchors, so windows can only recur
where an anchor recurs.

Candidates come from hashes, by steps that combine before they shuffle, whatever the size of a group:

1. runs, windows in a row with one anchor (some half a window length; in periodic text one run).  Runs
   whose anchor is met once go.
2. a run whose whole text is met again gets a partner: the least of its places, or the greatest for the
   least itself.
3. runs met once whose anchor has other texts are cut finer: into blocks of windows that share a core
   (only blocks whose core is met again go on), and last into windows.  What is met again gets a partner.

Verdicts come from contents alone.  Texts are cut by a fixed grid into cells; a candidate's cell and its
partner's cell meet, and a judge (suffix intervals or phrase automata) looks at the texts of many such
pairs together.  It finds every window of a cell that starts anywhere else.  A clash of hashes makes two
cells meet for nothing.  Cells are about a kilobyte, so no step holds more of a document, of a group or
of copies than a batch; a cell that very many others have as partner is on one side of a join whose
hot partitions Spark splits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm.shared import Scratch, chunks, slices, text_of, utf8

_MUL = np.uint64(0xD6E8FEB86659FD93)
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_WRAP = (1 << 64) - 1
_LOW = np.uint64(0xFFFFFF)
#: Windows looked at together; places within must fit in 24 bits.
_BLOCK = 1 << 17
#: Windows of a run at most.
LONGEST = 2048
#: Cells in a row whose partners lead to one place, and cells judged at one place before it is split.
STRETCH, CROWD = 16, 256
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


@dataclass(frozen=True)
class Units:
    """kind: "bytes" or "words"; window: units in a window; anchor: units in an anchor, a power of 2;
    cell: units of the grid; finer: windows in the blocks that runs met once are cut into, the last 1."""

    kind: str
    window: int
    anchor: int
    cell: int
    finer: tuple[int, ...]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * _MUL
    x ^= x >> np.uint64(32)
    return x


#: The hash of each byte.
_BYTES = _mixed(np.arange(1, 257, dtype=np.uint64))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Block:
    """Some texts, as units: values to hash, and each unit's first and last byte in ``line``."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, kind: str):
        if kind == "bytes":
            self.line, self.first = raw, offsets
            self.values = _BYTES[raw]
            self.starts = self.ends = None
            return
        space = _IS_SPACE[raw]
        before = np.empty(len(raw), bool)
        if len(raw):
            before[0], before[1:] = True, space[:-1]
            heads = offsets[:-1][offsets[:-1] < len(raw)]
            before[heads] = True  # a text's first byte follows nothing
        begin = np.flatnonzero(~space & before)
        after = np.empty(len(raw), bool)
        if len(raw):
            after[-1], after[:-1] = True, space[1:]
            tails = offsets[1:][(offsets[1:] > 0)] - 1
            after[tails] = True
        end = np.flatnonzero(~space & after) + 1
        self.first = np.searchsorted(begin, offsets)
        # One space between words: the line whose slices are compared.
        sizes = end - begin
        self.ends = np.cumsum(sizes + 1) - 1
        self.starts = self.ends - sizes
        line = np.full(int(self.ends[-1]) + 1 if len(sizes) else 0, 0x20, np.uint8)
        keep = np.ones(len(line), bool)
        keep[self.ends] = False
        line[keep] = raw[~space]
        self.line = line
        self.raw_starts, self.raw_ends = begin, end
        powers = _powers(_BASE, len(line) + 1)
        back = _powers(pow(_BASE, -1, 1 << 64), len(line) + 1)
        sums = np.zeros(len(line) + 1, np.uint64)
        np.cumsum((line.astype(np.uint64) + np.uint64(1)) * powers[:-1], dtype=np.uint64, out=sums[1:])
        x = (sums[self.ends] - sums[self.starts]) * back[self.starts] + sizes.astype(np.uint64) * _MIX
        self.values = _mixed(x)

    def bounds(self, unit: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the line that n units from each unit take up."""
        return (unit, unit + n) if self.starts is None else (self.starts[unit], self.ends[unit + n - 1])

    def cut(self, unit: int, n: int) -> tuple[int, int]:
        if self.starts is None:
            return unit, unit + n
        return int(self.starts[unit]), int(self.ends[unit + n - 1])


def anchors(values: np.ndarray, anchor: int) -> np.ndarray:
    """The hash of the ``anchor`` units that begin at each."""
    hashes, power, size = values, _BASE, 1
    while size < anchor:
        hashes = hashes[:-size] * np.uint64(power) + hashes[size:]
        power, size = power * power & _WRAP, size * 2
    hashes = hashes ^ (hashes >> np.uint64(29))
    hashes *= _MIX
    hashes ^= hashes >> np.uint64(32)
    return hashes


def _least(hashes: np.ndarray) -> np.ndarray:
    """What orders anchors: the upper 40 bits of their hash, which leave room for a place."""
    return hashes & ~_LOW


def runs(values: np.ndarray, first: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, windows, whether they can repeat) of every run; ``first`` holds the units where texts begin, and the end.

    A window's anchor is the leftmost of the least.  A run goes on while the anchor's hash stays, so in
    periodic text it is long (at most ``LONGEST``), and only where the place of the anchor changes within
    it can two of its windows be equal.
    """
    none = np.zeros(0, np.int64)
    if len(values) < window:
        return np.zeros(0, np.uint64), none, none, np.zeros(0, bool)
    hashes = anchors(values, anchor)
    least = _least(hashes) | np.arange(len(hashes), dtype=np.uint64)
    span, size = window - anchor + 1, 1
    while size * 2 <= span:
        least, size = np.minimum(least[:-size], least[size:]), size * 2
    if size < span:
        least = np.minimum(least[: len(least) - (span - size)], least[span - size :])
    place = (least & _LOW).astype(np.int64)
    h = hashes[place]
    inside = np.zeros(len(h) + 1, np.int8)  # windows that cross into the next text are none
    begin, stop = first[:-1], np.maximum(first[:-1], first[1:] - window + 1)
    real = stop > begin
    inside[begin[real]] += 1
    inside[stop[real]] -= 1
    inside = np.cumsum(inside[:-1]) > 0
    edge = np.ones(len(h), bool)
    edge[1:] = (h[1:] != h[:-1]) | (inside[1:] != inside[:-1])
    edge[begin[real]] = True
    at = np.flatnonzero(edge)
    size = np.diff(np.append(at, len(h)))
    real = inside[at]
    at, size = at[real], size[real]
    if len(size) and size.max() > LONGEST:
        parts = -(-size // LONGEST)
        skip = (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * LONGEST
        at, size = np.repeat(at, parts) + skip, np.minimum(np.repeat(size, parts) - skip, LONGEST)
    return h[at], at, size, place[at + size - 1] != place[at]


def blocks(column, kind: str) -> Iterator[tuple[Block, int, int]]:
    """(block, first row, rows): so many bytes of texts at a time that their arrays stay in a cache, and a longer text by itself."""
    raw, offsets = utf8(column)
    for a, b in chunks(offsets, _BLOCK):
        yield Block(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], kind), a, b - a


def _runs_of(block: Block, units: Units) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    n = len(block.values)
    if n <= 16 * _BLOCK:
        yield runs(block.values, block.first, units.window, units.anchor)
        return
    for a in range(0, n - units.window + 1, 8 * _BLOCK):  # one very long text
        b = min(n, a + 8 * _BLOCK + units.window - 1)
        first = np.unique(np.concatenate([[a], block.first[(block.first > a) & (block.first < b)], [b]])) - a
        h, at, size, turns = runs(block.values[a:b], first, units.window, units.anchor)
        yield h, at + a, size, turns


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def find_runs(docs: DataFrame, units: Units) -> DataFrame:
    """(h, s, r1, r2, start, nwin, turns): every run of every text of ``docs`` (r1, r2, text).

    h: its anchor; s: the hash of its text; turns: whether two of its windows can be equal.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in slices(batches):
            for block, row, _ in blocks(batch.column(2), units.kind):
                view = memoryview(block.line)
                for h, at, size, turns in _runs_of(block, units):
                    if not len(at):
                        continue
                    last = at + size + units.window - 2
                    p, q = (at, last + 1) if block.starts is None else (block.starts[at], block.ends[last])
                    s = np.fromiter((digest(view[x:y]) for x, y in zip(p.tolist(), q.tolist(), strict=True)), np.uint64, len(at))
                    text = np.searchsorted(block.first, at, side="right") - 1
                    owner = pa.array(text + row)
                    start = (at - block.first[text]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [_signed(h), _signed(s), batch.column(0).take(owner), batch.column(1).take(owner), pa.array(start), pa.array(size.astype(np.int32)), pa.array(turns)],
                        names=["h", "s", "r1", "r2", "start", "nwin", "turns"],
                    )

    return docs.mapInArrow(run, "h long, s long, r1 long, r2 long, start int, nwin int, turns boolean")


def _place(*more: str):
    return F.struct("r1", "r2", "start", *more)


def _met(rows: DataFrame, *more: str) -> DataFrame:
    """(h, s, n, lo, hi): how often each text is met, and the least and the greatest of its places."""
    return rows.groupBy("h", "s").agg(F.count("*").alias("n"), F.min(_place(*more)).alias("lo"), F.max(_place(*more)).alias("hi"))


def _partners(rows: DataFrame, met: DataFrame) -> DataFrame:
    """(r1, r2, start, nwin, p1, p2, pstart) of every row whose text is met again.

    Rows repeated with key and text share a place; where all places are one, it is its own partner.
    """
    again = met.where("n > 1").select("h", "s", F.col("lo").alias("lo"), F.col("hi").alias("hi"))
    both = rows.join(again, ["h", "s"])
    own = (F.col("r1") == F.col("lo.r1")) & (F.col("r2") == F.col("lo.r2")) & (F.col("start") == F.col("lo.start"))
    other = F.when(own, F.col("hi")).otherwise(F.col("lo")).alias("p")
    return both.select("r1", "r2", "start", "nwin", other).select("r1", "r2", "start", "nwin", F.col("p.r1").alias("p1"), F.col("p.r2").alias("p2"), F.col("p.start").alias("pstart"))


def _cells(partners: DataFrame, cell: int) -> DataFrame:
    """(r1, r2, k, p1, p2, pk, a, b, pa, pb, twin): the cells of windows and of their partners.

    a and b: the least and, past it, the greatest window of the cell, pa and pb of the partner's; twin:
    both are of one place.
    """
    div = lambda x: F.floor(x / cell).cast("int")
    stop = F.col("start") + F.col("nwin")
    shift = F.col("pstart") - F.col("start")
    same = (F.col("r1") == F.col("p1")) & (F.col("r2") == F.col("p2")) & (shift == 0)
    rows = partners.select("r1", "r2", "p1", "p2", "start", stop.alias("stop"), shift.alias("shift"), same.alias("twin"), F.explode(F.sequence(div(F.col("start")), div(stop - 1))).alias("k"))
    low, high = F.greatest("start", F.col("k") * cell), F.least("stop", (F.col("k") + 1) * cell)
    rows = rows.select("r1", "r2", "k", "p1", "p2", "twin", "shift", low.alias("low"), high.alias("high"))
    first, last = F.col("low") + F.col("shift"), F.col("high") + F.col("shift")
    rows = rows.select("*", F.explode(F.sequence(div(first), div(last - 1))).alias("pk"))
    first, last = F.greatest(first, F.col("pk") * cell), F.least(last, (F.col("pk") + 1) * cell)
    return rows.select("r1", "r2", "k", "p1", "p2", "pk", F.col("low").alias("a"), F.col("high").alias("b"), first.alias("pa"), last.alias("pb"), "twin")


def _edges(cells: DataFrame) -> DataFrame:
    """(r1, r2, k, a, b, lead, meets) of every cell: all of its windows, and the partners' cells, each once.

    lead: where the cell is judged, a stretch of ``STRETCH`` cells of one of its partners.  Cells that
    meet the same text then come together, and that text is looked at once for many of them.
    """
    pairs = cells.groupBy("r1", "r2", "k", "p1", "p2", "pk").agg(
        F.min("a").alias("a"), F.max("b").alias("b"), F.min("pa").alias("pa"), F.max("pb").alias("pb"), F.max("twin").alias("twin")
    )
    lead = F.min(F.xxhash64("p1", "p2", F.floor(F.col("pk") / STRETCH)))
    meets = F.collect_list(F.struct("p1", "p2", "pk", "pa", "pb", "twin"))
    return pairs.groupBy("r1", "r2", "k").agg(F.min("a").alias("a"), F.max("b").alias("b"), lead.alias("lead"), meets.alias("meets"))


def _dealt(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``edges`` with ``deal``: its lead, which beyond ``CROWD`` cells is split by text into parts of about as many."""
    crowds = edges.groupBy("lead").agg(F.count("*").alias("c")).where(F.col("c") > CROWD)
    crowds = scratch.table("crowds", crowds)
    parts = F.coalesce(F.ceil(F.col("c") / CROWD), F.lit(1))
    return edges.join(crowds, "lead", "left").withColumn("deal", F.xxhash64("lead", F.pmod(F.xxhash64("r1", "r2"), parts)))


def _with_places(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(r1, r2, text, places) of the texts that have any; of rows repeated with key and text one."""
    return packed(docs).join(places, ["r1", "r2"]).dropDuplicates(["r1", "r2"]).select("r1", "r2", "text", "places")


def _texts(batch: pa.RecordBatch, units: Units) -> Iterator[tuple[int, list, Block, int, int]]:
    """(row, places, block, first unit, units) of every text of a batch (r1, r2, text, places)."""
    for block, row, count in blocks(unpacked(batch.column(2)), units.kind):
        for r in range(count):
            yield row + r, batch.column(3)[row + r].as_py(), block, int(block.first[r]), int(block.first[r + 1] - block.first[r])


def _batched(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType], weight: Callable[[tuple], int], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    out, size = [], 0
    for x in rows:
        out.append(x)
        size += weight(x) + 64
        if size > most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def _run_texts(docs: DataFrame, pool: DataFrame, units: Units) -> DataFrame:
    """(r1, r2, run, piece) of the runs of ``pool`` (r1, r2, start, nwin): their units, words parted by one space."""
    places = pool.groupBy("r1", "r2").agg(F.collect_set(F.struct("start", "nwin")).alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            r1, r2 = batch.column(0).to_pylist(), batch.column(1).to_pylist()

            def rows(batch=batch, r1=r1, r2=r2):
                for r, places, block, first, _ in _texts(batch, units):
                    for x in places:
                        p, q = block.cut(first + x["start"], x["nwin"] + units.window - 1)
                        yield r1[r], r2[r], x["start"], block.line[p:q].tobytes()

            yield from _batched(rows(), ["r1", "r2", "run", "piece"], [pa.int64(), pa.int64(), pa.int32(), pa.binary()], lambda x: len(x[3]))

    return _with_places(docs, places).mapInArrow(run, "r1 long, r2 long, run int, piece binary")


def _finer(pieces: DataFrame, units: Units, size: int) -> DataFrame:
    """(h, s, r1, r2, start, nwin, run) of the blocks of at most ``size`` windows of (r1, r2, run, piece, ranges).

    Blocks follow from each window's distance to its anchor, so equal windows lie at the same place of
    their blocks.  h: what all windows of a block hold (for single windows the window); s: the block.
    """
    w = units.window

    def cut(block: Block, wanted: np.ndarray) -> tuple[np.ndarray, ...]:
        """(first unit, windows, anchor, distance to it in blocks) of the blocks of some pieces."""
        n = len(block.values)
        least = np.full(n, np.uint64(_WRAP))
        found = _least(anchors(block.values, units.anchor))
        least[: len(found)] = found
        sizes = np.diff(block.first)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        to_end = block.first[1:][owner] - np.arange(n)
        least[to_end < units.anchor] = _WRAP  # these reach into the next piece
        lowest = np.minimum.reduceat(least, block.first[:-1])
        place = np.where(least == lowest[owner], np.arange(n), n)
        place = np.minimum.accumulate(place[::-1])[::-1]
        ok = (to_end >= w) & wanted
        part = (place - np.arange(n)) // size
        edge = ok.copy()
        edge[1:] &= ~ok[:-1] | (place[1:] != place[:-1]) | (part[1:] != part[:-1]) | (owner[1:] != owner[:-1])
        at = np.flatnonzero(edge)
        return at, np.add.reduceat(ok.astype(np.int64), at) if len(at) else at, place[at], part[at], owner[at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, core = xxhash.xxh3_64_intdigest, xxhash.xxh3_64_intdigest
        for batch in slices(batches):
            ranges, starts = batch.column(4).to_pylist(), batch.column(2).to_numpy()
            for block, row, count in blocks(batch.column(3), units.kind):
                wanted = np.ones(len(block.values), bool)
                for r in range(count):
                    if ranges[row + r] is not None:
                        base = int(block.first[r]) - int(starts[row + r])
                        wanted[block.first[r] : block.first[r + 1]] = False
                        for x in ranges[row + r]:
                            wanted[base + x["start"] : base + x["start"] + x["nwin"]] = True
                at, n, place, part, owner = cut(block, wanted)
                if not len(at):
                    continue
                view = memoryview(block.line)
                p, q = block.bounds(at, n + w - 1)
                pairs = zip(p.tolist(), q.tolist(), strict=True)
                if size == 1:
                    both = [xxhash.xxh3_128_intdigest(view[x:y]) for x, y in pairs]
                    h, s = [x >> 64 for x in both], [x & _WRAP for x in both]
                else:
                    s = [whole(view[x:y]) for x, y in pairs]
                    # The core follows from the anchor, so that a block which the run cuts short has a whole one's.
                    p, q = block.bounds(place - size * part, np.full(len(at), w - size + 1))
                    h = [core(view[x:y], k + 1) for x, y, k in zip(p.tolist(), q.tolist(), part.tolist(), strict=True)]
                take = [batch.column(k).take(pa.array(owner + row)) for k in range(3)]
                start = take[2].to_numpy() + (at - block.first[owner])
                yield pa.RecordBatch.from_arrays(
                    [_signed(np.array(h, np.uint64)), _signed(np.array(s, np.uint64)), take[0], take[1], pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), take[2]],
                    names=["h", "s", "r1", "r2", "start", "nwin", "run"],
                )

    return pieces.select("r1", "r2", "run", "piece", "ranges").mapInArrow(run, "h long, s long, r1 long, r2 long, start int, nwin int, run int")


#: The text of some windows: (r1, r2, first window, units).
Piece = tuple[int, int, int, bytes]


@dataclass
class Batch:
    """Cells to be judged, the pieces of other places that each meets, and the cells of rows that are repeated."""

    own: list[Piece]
    partners: list[list[Piece]]
    twins: set[int]

    def whole(self, k: int) -> bool:
        """Whether the cell's text as a whole is that of another place: then all of its windows recur."""
        own = self.own[k]
        return k in self.twins or any(x[3] == own[3] and x[:3] != own[:3] for x in self.partners[k])


#: Judges one batch: for each of its own cells which windows start anywhere else.
Judge = Callable[[Batch, Units], list[np.ndarray]]


def spans_of(mask: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Runs of marked windows as (first unit, units)."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return [(int(a), int(b - a) + window - 1) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def _cut_cells(docs: DataFrame, wanted: DataFrame, units: Units) -> DataFrame:
    """(r1, r2, k, a, deal, cell) of the cells ``wanted`` (r1, r2, k, a, b, deal): the text of the windows from a to b."""
    places = wanted.groupBy("r1", "r2").agg(F.collect_list(F.struct("k", "a", "b", "deal")).alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            r1, r2 = batch.column(0).to_pylist(), batch.column(1).to_pylist()

            def rows(batch=batch, r1=r1, r2=r2):
                for r, places, block, first, _ in _texts(batch, units):
                    for x in places:
                        p, q = block.cut(first + x["a"], x["b"] - x["a"] + units.window - 1)
                        yield r1[r], r2[r], x["k"], x["a"], x["deal"], block.line[p:q].tobytes()

            yield from _batched(rows(), ["r1", "r2", "k", "a", "deal", "cell"], [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()], lambda x: len(x[5]))

    return _with_places(docs, places).mapInArrow(run, "r1 long, r2 long, k int, a int, deal long, cell binary")


def _judged(cells: DataFrame, partners: DataFrame, units: Units, judge: Judge, batch_bytes: int) -> DataFrame:
    """(r1, r2, span) of the windows that a judge finds in ``cells`` (r1, r2, k, a, deal, cell).

    ``partners``: (r1, r2, k, p1, p2, pa, deal, twin, cell), the texts that each cell meets.  Cells of one
    deal come one after the other, of a text in their order, so that what they meet lies together too.
    """
    none = lambda kind: F.lit(None).cast(kind)
    own = cells.select("deal", "r1", "r2", "k", none("long").alias("p1"), none("long").alias("p2"), "a", F.lit(False).alias("twin"), "cell")
    rows = own.union(partners.select("deal", "r1", "r2", "k", "p1", "p2", "pa", "twin", "cell"))
    rows = rows.repartition("deal").sortWithinPartitions("deal", "r1", "r2", "k", "p1").drop("deal")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, size = Batch([], [], set()), 0

        def verdicts() -> Iterator[tuple]:
            for (r1, r2, first, _), mask in zip(now.own, judge(now, units), strict=True):
                for a, n in spans_of(mask, units.window):
                    yield r1, r2, {"a": first + a, "n": n}

        kinds = [pa.int64(), pa.int64(), pa.struct([("a", pa.int32()), ("n", pa.int32())])]
        for batch in slices(batches):
            for r1, r2, _, p1, p2, a, twin, cell in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if p1 is None:  # nulls come first: a cell, then what it meets
                    if size >= batch_bytes:
                        yield from _batched(verdicts(), ["r1", "r2", "span"], kinds, lambda x: 32)
                        now, size = Batch([], [], set()), 0
                    now.own.append((r1, r2, a, cell))
                    now.partners.append([])
                elif twin:
                    now.twins.add(len(now.own) - 1)
                else:
                    now.partners[-1].append((p1, p2, a, cell))
                size += len(cell)
        if now.own:
            yield from _batched(verdicts(), ["r1", "r2", "span"], kinds, lambda x: 32)

    return rows.mapInArrow(run, "r1 long, r2 long, span struct<a:int,n:int>")


def _part(units: Units):
    """The units of the windows from pa to pb, of a partner's cell whose first window is ``first``."""
    begin, size = F.col("pa") - F.col("first"), F.col("pb") - F.col("pa") + (units.window - 1)
    if units.kind == "bytes":
        return F.substr("cell", begin + 1, size)
    return F.array_join(F.slice(F.split(F.col("cell").cast("string"), " "), begin + 1, size), " ").cast("binary")


def recurring_spans(docs: DataFrame, units: Units, judge: Judge, scratch: Scratch, batch_bytes: int = 384 << 10) -> DataFrame:
    """(r1, r2, spans): for texts that have any, the units covered by a window that starts anywhere else."""
    source = docs.select("r1", "r2", "text")
    every = scratch.table("runs", find_runs(source, units))
    shared = every.groupBy("h").agg(F.count("*").alias("c"), F.max("turns").alias("t")).where("c > 1 or t").select("h")
    shared = scratch.table("shared", shared)
    # Dealt by text: rows of a hot run then lie in many files, so that Spark can split the joins that they meet in.
    kept = scratch.table("kept", every.join(shared, "h").repartition("r1", "r2"))
    scratch.drop("runs", "shared")
    met = scratch.table("met", _met(kept, "nwin", "turns"))
    cells = [_cells(_partners(kept, met), units.cell)]
    undecided = F.max((F.col("n") == 1) & F.col("lo.turns"))
    open_ = met.groupBy("h").agg(F.count("*").alias("m"), F.min("n").alias("least"), undecided.alias("t")).where("(m > 1 and least = 1) or t")
    pool = met.join(scratch.table("open", open_.select("h")), "h").select("lo.*")
    pieces = scratch.table("pieces", _run_texts(source, pool, units))
    ranged = pieces.withColumn("ranges", F.lit(None).cast("array<struct<start:int,nwin:int>>"))
    for size in units.finer:
        rows = scratch.table(f"rows{size}", _finer(ranged, units, size))
        found = scratch.table(f"met{size}", _met(rows, "nwin", "run"))
        cells.append(_cells(_partners(rows, found), units.cell))
        if size == 1:
            break
        open_ = found.groupBy("h").agg(F.count("*").alias("m"), F.min("n").alias("least")).where("m > 1 and least = 1")
        left = found.join(scratch.table(f"open{size}", open_.select("h")), "h").select("lo.*")
        ranges = left.groupBy("r1", "r2", "run").agg(F.collect_list(F.struct("start", "nwin")).alias("ranges"))
        ranged = pieces.join(scratch.table(f"left{size}", ranges), ["r1", "r2", "run"])
    edges = cells[0]
    for more in cells[1:]:
        edges = edges.union(more)
    edges = scratch.table("edges", _edges(edges))
    scratch.keep("edges")
    edges = _dealt(edges, scratch)
    # A partner's windows met others too, so its cell is among the own ones, and holds them.
    texts = scratch.table("cells", _cut_cells(source, edges, units))
    partner = texts.select(F.col("r1").alias("p1"), F.col("r2").alias("p2"), F.col("k").alias("pk"), F.col("a").alias("first"), "cell")
    meets = edges.select("deal", "r1", "r2", "k", F.inline("meets"))
    partner = meets.join(partner, ["p1", "p2", "pk"]).select("deal", "r1", "r2", "k", "p1", "p2", "pa", "twin", _part(units).alias("cell"))
    judged = _judged(texts, partner, units, judge, batch_bytes)
    spans = scratch.table("spans", judged.groupBy("r1", "r2").agg(F.array_sort(F.collect_set("span")).alias("spans")))
    scratch.keep("spans")
    return spans


def keyed(docs: DataFrame, text: str = "text", key: str = "doc_id", *more: str) -> DataFrame:
    """(doc, r1, r2, more, text): r1 and r2, 128 bits of key and text, tell rows apart that differ in either."""
    body = text_of(text)
    one, two = F.xxhash64(body, F.col(key)), F.xxhash64(F.lit(7), F.col(key).isNull(), F.col(key), body)
    return docs.select(F.col(key).alias("doc"), one.alias("r1"), two.alias("r2"), *more, body.alias("text"))


def packed(docs: DataFrame) -> DataFrame:
    """``docs`` with each text, its last column, compressed by itself: what is joined then shuffles and spills less."""
    kinds = ", ".join(f"{c} {t}" for c, t in docs.dtypes[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in slices(batches):
            raw, at = utf8(batch.column(batch.num_columns - 1))
            view = memoryview(raw)
            small = pa.array([squeeze(view[p:q]) for p, q in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], small], names=batch.schema.names)

    return docs.mapInArrow(run, f"{kinds}, text binary")


def unpacked(column: pa.Array) -> pa.Array:
    restore = zstandard.ZstdDecompressor().decompress
    return pa.array([restore(x.as_py()) for x in column], pa.binary())


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc, text, spans): the packed text of every row of ``docs``, and the spans of the text or null."""
    return packed(docs).join(spans, ["r1", "r2"], "left").select("doc", "text", "spans")


def removed(n: int, spans) -> np.ndarray:
    """Which of n units the spans cover."""
    mark = np.zeros(n + 1, np.int32)
    if len(spans):
        pairs = np.array(spans, np.int64).reshape(-1, 2)
        np.add.at(mark, pairs[:, 0], 1)
        np.add.at(mark, pairs[:, 0] + pairs[:, 1], -1)
    return np.cumsum(mark[:-1]) > 0


__all__ = ["Units", "Block", "Batch", "runs", "recurring_spans", "keyed", "with_spans", "unpacked", "removed", "spans_of"]
