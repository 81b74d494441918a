"""SimHash fingerprints and near-duplicate groups by pigeonring filtering."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.llm.graph import components
from chronofold.llm.shared import Scratch, slices, whole_row

SEED = 42
BITS = 64
#: Buckets of at most this many fingerprints compare their pairs; larger ones meet over variants along the chain.
BUCKET = 32


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Bit k is 1 if it is set in over half the XXH64 hashes of the shingles, repeats included.

    ASCII letters are lower-cased; fewer words than a shingle: the whole sequence; none: 0.
    """
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and exactly the six ASCII spaces
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - shingle + 1].tolist()
    counts = np.zeros(BITS, np.int64)
    stops = ends[shingle - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for a in range(0, len(starts), 1 << 16):
        counts += _ones(np.array([digest(line[p:q], SEED) for p, q in zip(starts[a : a + (1 << 16)], stops[a : a + (1 << 16)], strict=True)], np.uint64))
    return _majority(counts, len(starts))


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set, in the order of ``unpackbits``."""
    bits = np.unpackbits(hashes.view(np.uint8)).reshape(-1, BITS)
    # Sums of at most 255 rows fit in a byte, which numpy adds many at a time.
    return np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0, dtype=np.uint8).sum(0, dtype=np.int64)


def _majority(counts: np.ndarray, n: int) -> int:
    return int.from_bytes(np.packbits((counts * 2 > n).astype(np.uint8)).tobytes(), "little")


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of a set of hashes; of none 0."""
    return _majority(_ones(hashes), len(hashes)) if len(hashes) else 0


def fingerprints(docs: DataFrame, shingle: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fp) for every row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            column = batch.column(1)
            found = np.fromiter((fingerprint(x.as_py(), shingle) for x in column), np.uint64, len(column))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=[key, "fp"])

    source = docs.select(F.col(key), F.col(text).cast("string").alias("_text"))
    return source.mapInArrow(run, f"`{key}` {dict(source.dtypes)[key]}, fp long")


def layout(budget: int) -> list[tuple[int, int]]:
    """(shift, width) of the ring's segments: two for each bit of the budget and one more.

    With m segments and a budget t the l segments of a chain may differ in floor(l t / m) bits.
    For m = 2 t + 1 that is 0 for the first two, so a chain starts with two equal segments and
    the bucket key is about 2 / m of the bits.
    """
    m = 2 * budget + 1
    edges = [BITS * k // m for k in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _segment(fp: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))


def _chain(start: Column, a: Column, b: Column, budget: int) -> Column:
    """Whether every prefix of the chain from ``start`` stays within its proportional budget."""
    ring = layout(budget)
    m = len(ring)
    diff = a.bitwiseXOR(b)
    ok = F.lit(False)
    for s in range(m):
        total, viable = F.lit(0), start == s
        for length in range(1, m):
            total = total + F.bit_count(_segment(diff, *ring[(s + length - 1) % m]))
            if length > 2:  # the key holds the first two
                viable = viable & (total <= length * budget // m)
        ok = ok | viable
    return ok


#: Widest budget: half of it is enumerated, and that table (some 2 MB at 6) is sent to every task.
WIDEST = 6


def flips(budget: int) -> list[tuple[int, int, int]]:
    """(start, mask, bits): what half the budget can flip along each chain.

    Bits of a mask lie outside the chain's first two segments, and every prefix of the chain holds no
    more of them than its proportional budget, as for a whole difference: two fingerprints that pass a
    chain share a variant that each reaches by such a mask, of at most floor(t / 2) and ceil(t / 2) bits.
    """
    ring = layout(budget)
    m = len(ring)
    most = -(-budget // 2)
    out = []
    for start in range(m):
        found = [(0, 0)]
        grown = found
        places = [(length, shift + k) for length in range(3, m + 1) for shift, width in [ring[(start + length - 1) % m]] for k in range(width)]
        for _ in range(most):
            more = []
            for mask, last in grown:
                for at in range(last, len(places)):
                    length, bit = places[at]
                    new = mask | 1 << bit
                    # Places rise along the chain, so only this prefix and longer ones grow.
                    if new.bit_count() <= length * budget // m:
                        more.append((new, at + 1))
            found = found + more
            grown = more
        out += [(start, mask - (1 << BITS) if mask >> 63 else mask, mask.bit_count()) for mask, _ in found]
    return out


def links(prints: DataFrame, scratch: Scratch, budget: int = 2, bucket: int = BUCKET) -> DataFrame:
    """Links (u, v) that connect the distinct fingerprints ``prints`` (fp) at ``budget`` or fewer differing bits.

    Each fingerprint goes to one bucket for each start of a chain.  In a bucket of at most
    ``bucket`` members, pairs pass the chain test and then the full Hamming check.  Larger buckets would
    make pairs with the square of their size; there every member sends out its variants along the chain
    (``flips``), and links to the least member that reaches the same variant with the smaller half.
    Those are within the budget of each other, and two members that pass the chain share a variant, so
    every group stays whole in linear work.  Any budget up to ``WIDEST``; a wider one is an error at once.
    """
    if not 0 <= budget <= WIDEST:
        raise ValueError(f"the budget must be from 0 to {WIDEST} bits")
    if not budget:  # distinct fingerprints differ
        return prints.select(F.col("fp").alias("u"), F.col("fp").alias("v")).where("u <> v")
    ring = layout(budget)
    m = len(ring)
    fp = F.col("fp")
    keys = [
        F.struct(F.lit(s).alias("s"), _segment(fp, *ring[s]).alias("k1"), _segment(fp, *ring[(s + 1) % m]).alias("k2"))
        for s in range(m)
    ]
    placed = prints.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.s", "k.k1", "k.k2")
    sizes = placed.groupBy("s", "k1", "k2").agg(F.count("*").alias("n")).where("n > 1")
    placed = scratch.table("placed", placed.join(sizes, ["s", "k1", "k2"]))
    few = placed.where(F.col("n") <= bucket)
    a, b = few.alias("a"), few.alias("b")
    apart = lambda x, y: F.bit_count(x.bitwiseXOR(y))
    near = (F.col("a.fp") < F.col("b.fp")) & _chain(F.col("a.s"), F.col("a.fp"), F.col("b.fp"), budget)
    near = near & (apart(F.col("a.fp"), F.col("b.fp")) <= budget)
    same = (F.col("a.s") == F.col("b.s")) & (F.col("a.k1") == F.col("b.k1")) & (F.col("a.k2") == F.col("b.k2"))
    found = a.join(b, same & near).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
    many = placed.where(F.col("n") > bucket)
    if many.isEmpty():
        return found.distinct()
    masks = F.broadcast(scratch.spark.createDataFrame(flips(budget), "s int, mask long, bits int"))
    variants = many.join(masks, "s").select("s", "fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("w"), "bits")
    least = variants.groupBy("s", "w").agg(F.min(F.when(F.col("bits") <= budget // 2, F.col("fp"))).alias("low"), F.count("*").alias("n"))
    stars = variants.join(least.where("n > 1"), ["s", "w"]).where("fp <> low").where(apart(F.col("fp"), F.col("low")) <= budget)
    return found.union(stars.select(F.col("fp").alias("u"), F.col("low").alias("v"))).distinct()


def near_groups(
    docs: DataFrame, scratch: Scratch, shingle: int = 3, budget: int = 2, text: str = "text", key: str = "doc_id", bucket: int = BUCKET
) -> DataFrame:
    """(key, fingerprint, component_id) for every row of ``docs``.

    component_id is the smallest key that links of at most ``budget`` differing bits reach.
    Only distinct fingerprints are compared; copies take their group's id by a join.

    Empty table: no rows.  Null or blank text: fingerprint 0, linked like any other.  Null key:
    kept as a row, never a component_id unless its group has no other.  Repeated rows: one output
    row each.  Very long text: counted in slices of 65,536 shingles.  Other columns are ignored.
    """
    own = scratch.table("own", fingerprints(docs, shingle, text, key))
    prints = own.groupBy("fp").agg(F.min(key).alias("low"))
    prints = scratch.table("prints", prints)
    joined = scratch.table("links", links(prints.select("fp"), scratch, budget, bucket))
    scratch.drop("placed")
    found = components(joined, scratch)
    lowest = found.join(prints, F.col("node") == F.col("fp")).groupBy("root").agg(F.min("low").alias("component"))
    linked = found.join(lowest, "root").select(F.col("node").alias("fp"), "component")
    group = prints.join(linked, "fp", "left").select("fp", F.coalesce("component", "low").alias("component_id"))
    group = scratch.table("groups", group)
    scratch.keep("own", "groups")
    return own.join(group, "fp").select(key, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, groups: Callable[[DataFrame, str], DataFrame], text: str = "text", key: str = "doc_id") -> DataFrame:
    """Exactly one row of each group of ``docs``, whole and unchanged.

    ``groups(rows, own)`` gives (own, component_id) for rows of a text and a key ``own``, which has the
    row's key and a hash of all its columns.  The row with the smallest key stays, a null key only where
    the group has no other; of different rows with that key the one of the least hash; of equal rows one.
    """
    check = F.xxhash64(*[docs[c] for c in docs.columns])
    rows = docs.select(F.struct(F.col(key).isNull().alias("n"), F.col(key).alias("k"), check.alias("c")).alias("_own"), F.col(text))
    found = groups(rows, "_own").select(F.col("component_id.k").alias("_low"), F.col("component_id.c").alias("_check"))
    kept = found.distinct()
    rows = docs.select(whole_row(docs), F.col(key).alias("_key"), check.alias("_check"))
    stay = rows.join(kept, "_check").where(F.col("_key").eqNullSafe(F.col("_low")))
    return stay.dropDuplicates(["_check"]).select("_row.*")


def near_dedup(docs: DataFrame, scratch: Scratch, shingle: int = 3, budget: int = 2, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay: exactly one of each near-duplicate group, by ``keep_first``."""
    return keep_first(docs, lambda rows, own: near_groups(rows, scratch, shingle, budget, text, own), text, key)
