"""Best-fit packing of documents into token sequences by a grouping genetic algorithm."""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm.bpe import VOCABULARY, encode
from chronofold.llm.shared import Scratch, slices

END_ID = 0


@dataclass(frozen=True)
class Search:
    """block: pieces that are packed together; islands: populations of a block; epochs: after each, elites
    migrate; population, generations: of an island, the latter in each epoch; loosened: bins that a child
    empties; swept: bins that it then tries to fill better."""

    block: int = 2048
    islands: int = 3
    epochs: int = 4
    population: int = 5
    generations: int = 24
    loosened: int = 5
    swept: int = 250
    seed: int = 11


class Bins:
    """Bins of a capacity, found by the least room that is enough.

    A number whose bit r is set where some bin has r free places answers best fit in a few
    machine operations, whatever the number of bins.
    """

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.items: list[list[int]] = []
        self.room: list[int] = []
        self.by_room: dict[int, list[int]] = {}
        self.open = 0

    def add_bin(self, items: list[int], room: int) -> None:
        self.items.append(items)
        self.room.append(room)
        self.by_room.setdefault(room, []).append(len(self.items) - 1)
        self.open |= 1 << room

    def best_fit(self, item: int) -> None:
        size = self.sizes[item]
        fits = self.open >> size
        if not fits:
            self.add_bin([item], self.capacity - size)
            return
        room = (fits & -fits).bit_length() - 1 + size
        b = self.by_room[room].pop()
        if not self.by_room[room]:
            self.open ^= 1 << room
        self.items[b].append(item)
        room -= size
        self.room[b] = room
        self.by_room.setdefault(room, []).append(b)
        self.open |= 1 << room

    def fitness(self) -> float:
        """Falkenauer's: the mean square of how full bins are."""
        fill = 1 - np.array(self.room) / self.capacity
        return float((fill**2).mean()) if len(fill) else 1.0


def pack(sizes: list[int], order: list[int], capacity: int, keep: list[list[int]] = (), rooms: list[int] | None = None) -> Bins:
    """Best fit in the given order, after the bins to keep (``rooms``: their room, where it is known)."""
    bins = Bins(sizes, capacity)
    for k, items in enumerate(keep):
        bins.add_bin(list(items), capacity - sum([sizes[i] for i in items]) if rooms is None else rooms[k])
    for i in order:
        bins.best_fit(i)
    return bins


def _down(sizes: list[int], items) -> list[int]:
    return sorted(items, key=lambda i: (-sizes[i], i))


def fill_better(sizes: list[int], bins: list[list[int]], loose: list[int], rooms: list[int], order) -> None:
    """Exchange one or two pieces of a bin for one or two loose ones that fill it more, in place.

    A better filled bin dominates the worse one, and the loose pieces become smaller, so that they fit
    best into what is left.  Each of the bins in ``order`` is looked at once.
    """
    ways: list[tuple[int, tuple]] = []  # one or two loose pieces and their size, until these change
    sums: list[int] = []
    for b in order:
        items, room = bins[b], rooms[b]
        if not room:
            continue
        if not ways:
            ways = [(sizes[i], (i,)) for i in loose]
            ways += [(sizes[i] + sizes[j], (i, j)) for k, i in enumerate(loose) for j in loose[:k]]
            ways.sort(key=lambda x: x[0])
            sums = [x[0] for x in ways]
        best, out, into = 0, (), ()
        leave = [(0, ())] + [(sizes[i], (i,)) for i in items] + [(sizes[i] + sizes[j], (i, j)) for k, i in enumerate(items) for j in items[:k]]
        for gone, who in leave:
            at = bisect.bisect_right(sums, gone + room) - 1
            if at >= 0 and sums[at] - gone > best:
                best, out, into = sums[at] - gone, who, ways[at][1]
        if best:
            bins[b], rooms[b] = [i for i in items if i not in out] + list(into), room - best
            loose[:] = [i for i in loose if i not in into] + list(out)
            ways = []


def crossover(first: Bins, second: Bins, rng: np.random.Generator, search: Search) -> Bins:
    """The first parent with well-filled bins of the second injected whole.

    Bins of the first that hold a piece of an injected bin go, and so do a few of its worst; the pieces
    that lose their place by that fill other bins better where they can, and the rest are fitted best
    again, longest first.
    """
    n = len(second.items)
    rank = np.argsort(np.array(second.room) + rng.uniform(0, 0.5, n))  # the fullest first, equals in any order
    chosen = [second.items[b] for b in rank[: int(rng.integers(1, max(2, n // 10)))].tolist()]
    placed = {i for items in chosen for i in items}
    stay, loose = [], []
    for items in first.items:
        if placed.isdisjoint(items):
            stay.append(items)
        else:
            loose += [i for i in items if i not in placed]
    return _refit(first, chosen + stay, loose, rng, search)


def _refit(parent: Bins, bins: list[list[int]], loose: list[int], rng: np.random.Generator, search: Search) -> Bins:
    sizes, capacity = parent.sizes, parent.capacity
    rooms = [capacity - sum([sizes[i] for i in items]) for items in bins]
    worst = np.argsort([-r for r in rooms], kind="stable")[: max(1, search.loosened // 2)].tolist()
    gone = {*worst, *rng.integers(0, len(bins), search.loosened - len(worst)).tolist()} if bins else set()
    loose = loose + [i for b in sorted(gone) for i in bins[b]]
    rooms = [r for b, r in enumerate(rooms) if b not in gone]
    bins = [x for b, x in enumerate(bins) if b not in gone]
    rest = _down(sizes, loose)
    # The largest loose pieces are hardest to place: a bounded number of them is exchanged.
    some, rest = rest[:40], rest[40:]
    fill_better(sizes, bins, some, rooms, rng.permutation(len(bins))[: search.swept].tolist())
    return pack(sizes, _down(sizes, some + rest), capacity, bins, rooms)


def mutate(bins: Bins, rng: np.random.Generator, search: Search) -> Bins:
    """Empty the worst bins and a few others, and refit their pieces."""
    return _refit(bins, bins.items, [], rng, search)


def evolve(sizes: list[int], capacity: int, search: Search, island: int, epoch: int, elites: list[list[int]]) -> list[int]:
    """The best grouping that one island finds in one epoch, as a bin for each piece.

    ``elites`` are groupings from the epoch before: the island's own and its neighbour's.  The search
    ends where no grouping can have fewer bins.
    """
    rng = np.random.default_rng([search.seed, island, epoch, len(sizes)])
    least = -(-sum(sizes) // capacity)
    people: list[Bins] = []
    for grouping in elites:
        kept: dict[int, list[int]] = {}
        for i, b in enumerate(grouping):
            kept.setdefault(b, []).append(i)
        people.append(pack(sizes, [], capacity, list(kept.values())))
    if not people:
        people.append(pack(sizes, _down(sizes, range(len(sizes))), capacity))
    rank = lambda p: (len(p.items), -p.fitness())
    people.sort(key=rank)
    while len(people[0].items) > least and len(people) < search.population:
        # Best fit in falling order of sizes that are blurred a little: near as good, and all different.
        blur = np.array(sizes) * rng.uniform(0.8, 1.2, len(sizes))
        people.append(pack(sizes, np.argsort(-blur, kind="stable").tolist(), capacity))
    for _ in range(search.generations):
        people.sort(key=rank)
        if len(people[0].items) <= least:
            break
        a, b = people[int(rng.integers(0, 2))], people[int(rng.integers(0, len(people)))]
        child = crossover(a, b, rng, search) if a is not b else mutate(a, rng, search)
        people = sorted([*people, child, mutate(people[0], rng, search)], key=rank)[: search.population]
    best = min(people, key=rank)
    out = [0] * len(sizes)
    for b, items in enumerate(best.items):
        for i in items:
            out[i] = b
    return out


def pieces(docs: DataFrame, capacity: int = 2048, path: str = VOCABULARY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, piece, start, length, ids_crc32) of every document's ids and a final id 0.

    A document above the capacity is cut from its end into whole sequences; what remains is its first piece.
    """
    coded = encode(docs, path, text, key)
    kind = dict(coded.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            owner, number, start, length, crc = [], [], [], [], []
            for r, value in enumerate(batch.column(1)):
                data = value.as_py() + END_ID.to_bytes(4, "little")
                n = len(data) // 4
                edges = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    owner.append(r)
                    number.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(data[4 * a : 4 * b]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owner, pa.int64())), pa.array(number, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]],
                names=[key, "piece", "start", "length", "ids_crc32"],
            )

    return coded.mapInArrow(run, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long")


def _islands(blocks: DataFrame, n: int, capacity: int, search: Search, scratch: Scratch, name: str) -> DataFrame:
    """(block, pids, sizes, bins): the best grouping of each of ``n`` blocks after all epochs.

    Where there are several blocks, their badly filled bins are packed again, so half the epochs do.
    """
    epochs = search.epochs if n == 1 else -(-search.epochs // 2)

    def run(epoch: int):
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                out = [
                    evolve(sizes.as_py(), capacity, search, island.as_py(), epoch, elites.as_py() or [])
                    for island, sizes, elites in zip(batch.column(1), batch.column(2), batch.column(3), strict=True)
                ]
                counts = [len(set(x)) for x in out]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int32()), pa.array(out, pa.list_(pa.int32()))], names=["block", "island", "n", "bins"])

        return task

    split = F.explode(F.sequence(F.lit(0), F.lit(search.islands - 1)))
    found = None
    for epoch in range(epochs):
        alive = blocks.select("block", "sizes", split.alias("island"))
        if found is None:
            alive = alive.withColumn("elites", F.lit(None).cast("array<array<int>>"))
        else:
            # A ring: every island starts from its own elite and its neighbour's.
            own = found.select("block", "island", F.col("bins").alias("own"))
            other = found.select("block", ((F.col("island") + 1) % search.islands).alias("island"), F.col("bins").alias("other"))
            both = own.join(other, ["block", "island"])
            alive = alive.join(both, ["block", "island"]).select("block", "sizes", "island", F.array("own", "other").alias("elites"))
        # A block is a few kB and many milliseconds of work: without a number they would be put into very few tasks.
        alive = alive.repartition(max(search.islands, min(n * search.islands // 4, 4096)), "block", "island").select("block", "island", "sizes", "elites")
        found = scratch.table(f"{name}-{epoch}", alive.mapInArrow(run(epoch), "block long, island int, n int, bins array<int>"))
    best = found.groupBy("block").agg(F.min_by("bins", F.struct("n", "island")).alias("bins"))
    return blocks.join(best, "block")


def pack_pieces(parts: DataFrame, scratch: Scratch, capacity: int = 2048, search: Search = Search(), loose: float = 0.99) -> DataFrame:
    """(pid, sequence_id, offset) for every row of ``parts`` (pid, length), lengths at most ``capacity``.

    Pieces are dealt into blocks of about ``search.block`` by a hash, so no task holds more whatever
    the number of pieces.  Each block evolves on several islands, each a task, which pass their elite
    on between epochs.  Bins filled below ``loose`` are emptied and their pieces dealt into fewer
    blocks, until one block holds all of them: what stays open is about one sequence in all.
    """
    whole = parts.where(F.col("length") >= capacity).select("pid", (-F.col("pid") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    done = [whole]
    todo = parts.where(F.col("length") < capacity).select("pid", "length")
    for level in range(16):
        n = todo.count()
        if not n:
            break
        blocks = -(-n // search.block)
        dealt = todo.select(F.pmod(F.xxhash64("pid", F.lit(level)), F.lit(blocks)).alias("block"), F.struct("pid", "length").alias("x"))
        dealt = dealt.groupBy("block").agg(F.array_sort(F.collect_list("x")).alias("x"))
        dealt = scratch.table(f"blocks{level}", dealt.select("block", F.col("x.pid").alias("pids"), F.col("x.length").cast("array<int>").alias("sizes")))
        grouped = _islands(dealt, blocks, capacity, search, scratch, f"islands{level}")
        base = level << 58

        def place(batches: Iterator[pa.RecordBatch], base: int = base) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                for block, pids, sizes, bins in zip(*batch.columns, strict=True):
                    sizes, bins = np.array(sizes.as_py()), np.array(bins.as_py())
                    order = np.argsort(bins, kind="stable")
                    end = np.cumsum(sizes[order])
                    first = np.searchsorted(bins[order], bins[order])
                    offset = end - sizes[order] - (end - sizes[order])[first]
                    fill = np.bincount(bins, weights=sizes).astype(np.int64)[bins[order]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.array(pids.as_py())[order]), pa.array(sizes[order].astype(np.int64)), pa.array(base + (block.as_py() << 24) + bins[order].astype(np.int64)), pa.array(offset.astype(np.int64)), pa.array(fill)],
                        names=["pid", "length", "sequence_id", "offset", "fill"],
                    )

        schema = "pid long, length long, sequence_id long, offset long, fill long"
        placed = grouped.select("block", "pids", "sizes", "bins").mapInArrow(place, schema)
        placed = scratch.table(f"placed{level}", placed)
        scratch.drop(f"blocks{level}", *[f"islands{level}-{k}" for k in range(search.epochs)])
        if blocks == 1 or level == 15:
            done.append(placed.select("pid", "sequence_id", "offset"))
            break
        done.append(placed.where(F.col("fill") >= loose * capacity).select("pid", "sequence_id", "offset"))
        todo = placed.where(F.col("fill") < loose * capacity).select("pid", "length")
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def pack_documents(
    docs: DataFrame, scratch: Scratch, capacity: int = 2048, path: str = VOCABULARY, text: str = "text", key: str = "doc_id", search: Search = Search()
) -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every document.

    Null text: as empty, one piece of the final id.  Empty table: no rows.  Null keys and repeated
    rows: packed like any other.  Very long text: cut into whole sequences, in one task.  Other columns
    are ignored, whatever their names.
    """
    parts = pieces(docs, capacity, path, text, key).select(F.monotonically_increasing_id().alias("pid"), "*")
    parts = scratch.table("pieces", parts)
    return parts.join(pack_pieces(parts, scratch, capacity, search), "pid").drop("pid")
