"""Byte-level BPE encoding by tree concatenation, and decoding."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm.shared import slices, text_of

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: Texts up to this many characters are encoded as they are; longer ones by halves.
LEAF = 1 << 15
#: Characters on each side of a join that are encoded again at first; doubled until both sides agree.
WINDOW = 64


def _byte_letters() -> dict[str, int]:
    """Byte of each letter that byte-level vocabularies write: printable ones stand for themselves, others follow from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class Codec:
    """Encoder and decoder for one vocabulary file of the tokenizers library (byte-level BPE).

    Merges run in tiktoken, which gives the same ids several times faster; the file's added tokens
    are found in the text first, as that library does.
    """

    def __init__(self, path: str = VOCABULARY):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("not a plain byte-level BPE file")
        letters = _byte_letters()
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take their surroundings aren't supported")
        ranks = {bytes(letters[c] for c in token): k for token, k in spec["model"]["vocab"].items() if token not in self.added}
        self.core = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self.added)
        self.pieces = {k: b for b, k in ranks.items()} | {k: t.encode() for t, k in self.added.items()}
        self.longest_added = max(map(len, self.added), default=0)
        self.again = 0  # bytes that joins have encoded again

    def encode(self, text: str) -> list[int]:
        if any(t in text for t in self.added):
            return self.core.encode(text, allowed_special="all")
        return self.core.encode_ordinary(text)

    def encode_run(self, run: bytes) -> list[int]:
        """The ids of bytes that the pre-tokenizer leaves in one piece."""
        return self.core._core_bpe.encode_single_piece(run)

    def decode_bytes(self, ids) -> bytes:
        return self.core.decode_bytes(ids)


@lru_cache(2)
def codec(path: str = VOCABULARY) -> Codec:
    return Codec(path)


Part = tuple[str, list[int]]


@lru_cache(1 << 16)
def _kind(c: str) -> str:
    """The pre-tokenizer's class of a character: S white space, L letter, N number, O other, and ? where
    versions of Unicode could differ, or where a character has no class of its own in the oldest."""
    if c.isspace():
        return "S" if c in _SPACES else "?"
    now, then = unicodedata.category(c)[0], unicodedata.ucd_3_2_0.category(c)
    if then == "Cn" or then[0] != now:
        return "?"
    return now if now in "LN" else "O" if now in "MPS" else "?"


#: Characters that every version of the pattern takes for white space.
_SPACES = frozenset(" \t\n\x0b\x0c\r\xa0\u1680\u2028\u2029\u202f\u205f\u3000") | {chr(k) for k in range(0x2000, 0x200B)}


def _meet(before: str, after: str) -> bool:
    """Whether the pre-tokenizer always ends a piece between two characters.

    Pieces hold one class, but for a space before them and for a contraction, which begins with an
    apostrophe.  So a change of class ends a piece, unless white space or an apostrophe comes before it.
    """
    x, y = _kind(before), _kind(after)
    return x != y and x in "LNO" and y in "SLNO" and before != "'"


def _safe(text: str, places: range) -> int | None:
    """The first of ``places`` in the text where pieces always meet."""
    for k in places:
        if 0 < k < len(text) and _meet(text[k - 1], text[k]):
            return k
    return None


def _boundary(ids: list[int], size: int, c: Codec, backward: bool = False) -> int | None:
    """How many ids from the start (or the end) make up just ``size`` bytes."""
    total = n = 0
    for x in reversed(ids) if backward else ids:
        if total >= size:
            break
        total += len(c.pieces[x])
        n += 1
    return n if total == size else None


def _join_run(left: Part, right: Part, c: Codec, n: int) -> list[int] | None:
    """A join inside one unbroken run of letters, numbers, white space or others, with n old ids on each side.

    The window's text is merged anew.  Where its first and last ids equal the old ones, every pair of
    neighbours in the whole is a pair that byte-pair merging leaves alone, so the whole is the encoding.
    """
    (_, ia), (b, ib) = left, right
    if n > len(ia) or n > len(ib):
        return None
    window = b"".join(c.pieces[x] for x in ia[-n:] + ib[:n])
    try:
        text, after = window.decode(), len(b"".join(c.pieces[x] for x in ib[:n]).decode())
    except UnicodeDecodeError:
        return None
    if "'" in text or len(kinds := set(map(_kind, text))) > 1 or "?" in kinds:
        return None
    if "S" in kinds and after < len(b) and _kind(b[after]) != "S":
        return None  # the last white space of a run may have a piece of its own or begin the next word's
    c.again += len(window)
    new = c.encode_run(window)
    if new[0] == ia[-n] and new[-1] == ib[n - 1]:
        return ia[: len(ia) - n] + new + ib[n:]
    return None


def join(left: Part, right: Part, c: Codec, window: int = WINDOW) -> list[int]:
    """The ids of two texts' concatenation from the ids of each.

    A window around the join grows until it holds, on either side, a place where pieces always meet; the
    old ids have a boundary there too, so what lies outside agrees exactly, and only the window is
    encoded again.  Places nearest to the join are taken, in any script.  Inside one long run of one
    class there is no such place; there the window grows until its outer ids agree.  A window that covers
    both sides is the plain encoding.
    """
    (a, ia), (b, ib) = left, right
    margin = c.longest_added
    while True:
        new = _join_run(left, right, c, max(2, window // 8))
        if new is not None and not any(t in a[-margin:] + b[:margin] for t in c.added):
            return new
        ka, kb = min(len(a), window), min(len(b), window)
        middle = a[len(a) - ka :] + b[:kb]
        # An added token that lies across the join begins or ends within the margin.
        low = 0 if ka == len(a) else _safe(middle, range(ka - margin, margin, -1))
        high = len(middle) if kb == len(b) else _safe(middle, range(ka + margin, len(middle) - margin))
        if low is not None and high is not None:
            keep_a = 0 if low == 0 and ka == len(a) else _boundary(ia, len(middle[low:ka].encode()), c, backward=True)
            keep_b = len(ib) if high == len(middle) and kb == len(b) else _boundary(ib, len(middle[ka:high].encode()), c)
            if keep_a is not None and keep_b is not None:
                if low or ka < len(a):
                    keep_a = len(ia) - keep_a
                c.again += len(middle[low:high].encode())
                return ia[:keep_a] + c.encode(middle[low:high]) + ib[keep_b:]
        if ka == len(a) and kb == len(b):
            c.again += len((a + b).encode())
            return c.encode(a + b)
        window *= 2


def concatenate(parts: list[Part], c: Codec) -> list[int]:
    """The ids of all parts' texts together: neighbours are joined in pairs, level by level."""
    while len(parts) > 1:
        parts = [
            (parts[k][0] + parts[k + 1][0], join(parts[k], parts[k + 1], c)) if k + 1 < len(parts) else parts[k]
            for k in range(0, len(parts), 2)
        ]
    return parts[0][1] if parts else []


def leaves(text: str, leaf: int = LEAF) -> list[str]:
    """The text halved until no part is longer than ``leaf``."""
    if len(text) <= leaf:
        return [text]
    half = len(text) // 2
    return leaves(text[:half], leaf) + leaves(text[half:], leaf)


def _binary(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


def encode(docs: DataFrame, path: str = VOCABULARY, text: str = "text", key: str = "doc_id", leaf: int = LEAF) -> DataFrame:
    """(key, ids) for every row: ids as little-endian unsigned 32-bit integers.

    Equal to the tokenizers library's encode(text, add_special_tokens=False).  Texts above ``leaf``
    characters are dealt out in halves of halves, encoded in parallel by as many tasks, and joined.
    Null text: as empty, no ids.  Empty table: no rows.  Null keys and repeated rows: one row each.
    Very long text: no task but the one that joins it holds more than a leaf, and that one holds the
    text's characters and ids.  Other columns are ignored, whatever their names.
    """
    body = docs.select(F.col(key), text_of(text).alias("_text"))
    kind = dict(body.dtypes)[key]

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in slices(batches):
            ids = [_binary(c.encode(x.as_py())) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=[key, "ids"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for k in range(batch.num_rows):
                parts = leaves(batch.column(2)[k].as_py(), leaf)
                own = pa.array([k] * len(parts))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.string())], names=["rid", key, "part", "text"])

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in slices(batches):
            ids = [_binary(c.encode(x.as_py())) for x in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary())], names=["rid", key, "part", "text", "ids"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in slices(batches):
            out = []
            for parts in batch.column(1):
                out.append(_binary(concatenate([(p["text"], np.frombuffer(p["ids"], "<u4").tolist()) for p in parts.as_py()], c)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=[key, "ids"])

    long_ = F.length("_text") > leaf
    plain = body.where(~long_).mapInArrow(short, f"`{key}` {kind}, ids binary")
    dealt = body.where(long_).select(F.monotonically_increasing_id().alias("rid"), key, "_text")
    dealt = dealt.mapInArrow(cut, f"rid long, `{key}` {kind}, part int, text string").repartition("rid", "part")
    dealt = dealt.mapInArrow(one, f"rid long, `{key}` {kind}, part int, text string, ids binary")
    met = dealt.groupBy("rid").agg(F.first(key, ignorenulls=True).alias(key), F.array_sort(F.collect_list(F.struct("part", "text", "ids"))).alias("parts"))
    return plain.unionByName(met.select(key, "parts").mapInArrow(whole, f"`{key}` {kind}, ids binary"))


def decode(coded: DataFrame, path: str = VOCABULARY, ids: str = "ids") -> DataFrame:
    """``coded`` with a column decoded: the text of its ids, added tokens included.

    Bytes that are no UTF-8 become U+FFFD.  Null ids: null.
    """
    others = coded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        at = others.index(ids)
        for batch in slices(batches):
            text = [None if (x := v.as_py()) is None else c.decode_bytes(np.frombuffer(x, "<u4").tolist()).decode("utf-8", "replace") for v in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], names=[*others, "decoded"])

    schema = ", ".join(f"`{c}` {t}" for c, t in coded.dtypes)
    return coded.mapInArrow(run, f"{schema}, decoded string")
