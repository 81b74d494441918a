"""Suffix-array deduplication of byte strings: interval expansion on a Burrows-Wheeler transform."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm.recurrence import Batch, Units, keyed, recurring_spans, removed, unpacked, with_spans
from chronofold.llm.shared import Scratch, slices, utf8, whole_row

def suffix_array(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Starts of suffixes sorted by their first ``depth`` symbols; symbol 0 ends a text and equals no other end.

    The first sort is by as many symbols as one 63-bit number holds.  Each further one sorts the suffixes
    that still share a rank by the ranks of those two and three steps on: the length known triples.
    """
    n = len(symbols)
    kinds = np.bincount(symbols, minlength=1) > 0
    kinds[0] = True
    bits = max(1, int(kinds.sum() - 1).bit_length())
    pack = min(depth, 63 // bits)
    padded = np.concatenate([(np.cumsum(kinds) - 1)[symbols], np.zeros(pack, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(pack):
        key = (key << bits) | padded[k : k + n]
    ends = np.concatenate([[0], np.cumsum(padded == 0)])
    single = ends[pack : pack + n] != ends[:n]  # an end is within reach
    order = np.argsort(key)
    sorted_ = key[order]
    new = np.ones(n, bool)
    new[1:] = (sorted_[1:] != sorted_[:-1]) | single[order[1:]] | single[order[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # the place of a group's first suffix
    wide = max(1, n.bit_length())
    steps = 3 if 3 * wide <= 63 else 2
    size = pack
    while size < depth and not new.all():
        # Only suffixes that still share a rank are sorted again.
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        who = order[at]
        key = rank[who]
        for k in range(1, steps):
            key = (key << wide) | rank[np.minimum(who + k * size, n - 1)]
        again = np.argsort(key)
        who, key = who[again], key[again]
        order[at] = who
        fresh = np.ones(len(at), bool)
        fresh[1:] = key[1:] != key[:-1]
        new[at] = fresh
        rank[who] = np.maximum.accumulate(np.where(fresh, at, 0))
        size *= steps
    return order


def deep_boundaries(symbols: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """True at i where suffixes i - 1 and i of the array share at least ``depth`` symbols.

    Breadth-first backward extension: the interval of a string in the array leads to the intervals
    of the string with one symbol before it, found from the transform alone.  Level after level the
    right ends that are new are just the places whose common prefix has the level's length, and an
    interval whose right end is known is not extended.  Levels end at ``depth``; what is unknown
    then shares that much or more.
    """
    n = len(order)
    bwt = symbols[order - 1]  # the symbol before; before the first stands an end
    bwt[order == 0] = 0
    lf_order = np.argsort(bwt.astype(np.uint16), kind="stable")
    lf_order = lf_order.astype(np.int32)
    lf = np.empty(n, np.int32)
    lf[lf_order] = np.arange(n, dtype=np.int32)
    same = bwt[lf_order]
    lf[bwt == 0] = -1  # nothing stands before a text
    after = np.full(n, n, np.int32)
    before = np.full(n, -1, np.int32)
    pair = same[1:] == same[:-1]
    after[lf_order[:-1][pair]] = lf_order[1:][pair]
    before[lf_order[1:][pair]] = lf_order[:-1][pair]
    kinds = np.flatnonzero(np.bincount(same))
    keys = same.astype(np.int64) * (n + 1) + lf_order  # sorted: places of each symbol
    kinds = kinds[kinds > 0]
    known = np.zeros(n + 1, bool)
    known[[0, n]] = True
    ends = int((symbols == 0).sum())
    known[1 : ends + 1] = True  # ends sort first, and share nothing
    left = np.concatenate([[0], np.arange(ends)]).astype(np.int32)
    right = np.concatenate([[n], np.arange(1, ends + 1)]).astype(np.int32)

    def children(left, right):
        size = right - left
        one = size == 1
        at = lf[left[one]]
        at = at[at >= 0]
        lows, highs = [at], [at + 1]
        few = ~one & (size <= 64)
        if few.any():
            lo, hi, count = left[few], right[few], size[few]
            total = np.cumsum(count)
            at = np.arange(total[-1], dtype=np.int32) + np.repeat((lo - (total - count)).astype(np.int32), count)
            to = lf[at]
            real = to >= 0
            lows.append(np.sort(to[real & (before[at] < np.repeat(lo, count))]))
            highs.append(np.sort(to[real & (after[at] >= np.repeat(hi, count))]) + 1)
        wide = size > 64
        if wide.any():
            lo = np.searchsorted(keys, (kinds[:, None] * (n + 1) + left[wide][None, :]).ravel())
            hi = np.searchsorted(keys, (kinds[:, None] * (n + 1) + right[wide][None, :]).ravel())
            some = hi > lo
            lows.append(lo[some].astype(np.int32))
            highs.append(hi[some].astype(np.int32))
        return np.concatenate(lows), np.concatenate(highs)

    # Level 0 holds the empty string; its children and the ends, which are strings of one symbol, make level 1.
    lo, hi = children(left[:1], right[:1])
    fresh = ~known[hi]
    known[hi] = True
    left, right = np.concatenate([left[1:], lo[fresh | (hi == n)]]), np.concatenate([right[1:], hi[fresh | (hi == n)]])
    for _ in range(1, depth):
        if not len(left):
            break
        lo, hi = children(left, right)
        fresh = ~known[hi]
        left, right = lo[fresh], hi[fresh]
        known[right] = True
    return ~known[:n]


def recurring_windows(texts: list[bytes | bytearray], window: int) -> list[np.ndarray]:
    """For each text, which of its windows start anywhere else in all of them."""
    sizes = np.array([len(x) for x in texts], np.int64)
    line = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int64) + 1
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])
    line[begin[1:] - 1] = 0
    order = suffix_array(line, window)
    deep = deep_boundaries(line, order, window)
    shared = deep.copy()
    shared[:-1] |= deep[1:]
    mark = np.zeros(len(line), bool)
    mark[order[shared]] = True
    return [mark[a : a + max(0, size - window + 1)] for a, size in zip(begin.tolist(), sizes.tolist(), strict=False)]


def judge(batch: Batch, units: Units) -> list[np.ndarray]:
    """One array for the cells of a batch and what they meet; a cell whose whole text lies at another place is left out.

    Pieces of one text that overlap are put together first, so that no place is in the array twice.
    """
    open_ = [k for k in range(len(batch.own)) if not batch.whole(k)]
    pieces = sorted({x for k in open_ for x in (batch.own[k], *batch.partners[k])})
    texts: list[bytearray] = []
    begins: list[tuple[int, int, int]] = []
    for r1, r2, a, text in pieces:
        if begins and begins[-1][:2] == (r1, r2) and a <= begins[-1][2] + len(texts[-1]):
            texts[-1] += text[begins[-1][2] + len(texts[-1]) - a :]
        else:
            begins.append((r1, r2, a))
            texts.append(bytearray(text))
    found = recurring_windows(texts, units.window) if texts else []
    out = [np.ones(max(0, len(x[3]) - units.window + 1), bool) for x in batch.own]
    for k in open_:
        r1, r2, a, text = batch.own[k]
        at = bisect.bisect_right(begins, (r1, r2, a)) - 1
        out[k] = found[at][a - begins[at][2] :][: len(out[k])]
    return out


#: Windows of the blocks that runs met once are cut into, and bytes of a cell.
FINER, CELL = (16, 1), 2048
#: Bytes of cells, and of what they meet, that are judged in one array.
BATCH = 3 << 19


def repeated_bytes(docs: DataFrame, scratch: Scratch, window: int = 200, text: str = "text", key: str = "doc_id", anchor: int = 32) -> DataFrame:
    """Every row of ``docs`` as (doc, packed text, spans): the bytes that ``window``-byte strings which start anywhere else cover.

    Matches stay within one text, texts are UTF-8, null is empty, and all is judged on the input.
    Empty table: no rows.  A text shorter than the window: no spans.  Rows repeated with key and
    text: each is elsewhere for the other, so both lose all.  Very long texts: judged by cells of
    ``CELL`` bytes.  Other columns are ignored, whatever their names.
    """
    source = keyed(docs, text, key)
    return with_spans(source, recurring_spans(source, Units("bytes", window, anchor, CELL, FINER), judge, scratch, BATCH))


def remove_repeated_bytes(docs: DataFrame, scratch: Scratch, window: int = 200, text: str = "text", key: str = "doc_id", anchor: int = 32) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept) for every row; kept is binary."""
    marked = repeated_bytes(docs, scratch, window, text, key, anchor)
    kind = dict(marked.dtypes)["doc"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw, at = utf8(unpacked(batch.column(1)))
            sizes, gone, count, kept = [], [], [], []
            for k, spans in enumerate(batch.column(2)):
                part = raw[at[k] : at[k + 1]]
                pairs = [(x["a"], x["n"]) for x in spans.as_py() or ()]
                sizes.append(len(part))
                if not pairs:
                    gone.append(0)
                    count.append(0)
                    kept.append(part.tobytes())
                    continue
                mask = removed(len(part), pairs)
                gone.append(int(mask.sum()))
                count.append(int(np.count_nonzero(np.diff(np.concatenate([[0], mask.astype(np.int8)])) == 1)))
                kept.append(part[~mask].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.binary())],
                names=[key, "n_bytes", "n_removed", "n_spans", "kept"],
            )

    return marked.mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def strip_repeated_bytes(docs: DataFrame, scratch: Scratch, window: int = 200, text: str = "text", key: str = "doc_id", length: str = "n_chars", anchor: int = 32) -> DataFrame:
    """``docs`` with the repeated bytes taken out of its text; all columns and rows stay.

    Of a character that a removed span cuts, the remaining bytes go too.  ``length``, where there is
    such a column, becomes the new number of characters of a text that lost any.  Null text stays null.
    """
    source = keyed(docs, text, key)
    spans = recurring_spans(source, Units("bytes", window, anchor, CELL, FINER), judge, scratch, BATCH)
    columns = docs.columns
    spans = spans.withColumnsRenamed({"r1": "_r1", "r2": "_r2", "spans": "_spans"})
    ids = keyed(docs.select(whole_row(docs), F.col(key).alias("_key"), F.col(text).alias("_text")), "_text", "_key", "_row")
    joined = ids.withColumnsRenamed({"r1": "_r1", "r2": "_r2"}).join(spans, ["_r1", "_r2"], "left").select("_row", "_spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = batch.column(0).flatten()
            at = columns.index(text)
            texts = out[at].to_pylist()
            sizes = out[columns.index(length)].to_pylist() if length in columns else None
            for k, spans in enumerate(batch.column(1)):
                if (found := spans.as_py()) and texts[k] is not None:
                    raw = np.frombuffer(texts[k].encode(), np.uint8)
                    texts[k] = raw[~removed(len(raw), [(x["a"], x["n"]) for x in found])].tobytes().decode("utf-8", "ignore")
                    if sizes is not None:
                        sizes[k] = len(texts[k])
            out[at] = pa.array(texts, out[at].type)
            if sizes is not None:
                i = columns.index(length)
                out[i] = pa.array(sizes, out[i].type)
            yield pa.RecordBatch.from_arrays(out, names=columns)

    return joined.mapInArrow(run, docs.schema)
