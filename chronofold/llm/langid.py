"""Language identification by hyperdimensional profiles of letter n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.llm.shared import chunks, slices, utf8

UNKNOWN = "und"
#: Bytes of text that are looked at together; a longer text goes through in parts.
PART = 1 << 19


@dataclass(frozen=True)
class Space:
    """dims: length of a vector; letters: vectors drawn, 0 for what is no letter; gram: letters bound; seed."""

    dims: int = 1024
    letters: int = 64
    gram: int = 3
    seed: int = 7

    def table(self) -> np.ndarray:
        """A random vector of +1 and -1 for each letter."""
        return np.random.default_rng(self.seed).choice(np.array([-1, 1], np.int8), (self.letters, self.dims))


def _letter_codes(space: Space) -> np.ndarray:
    """Code of every code point of the basic plane: 0 if no letter, a-z by themselves, others by residue."""
    out = np.zeros(1 << 16, np.uint8)
    for cp in range(1 << 16):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            base = ord(low[0])
            out[cp] = base - 96 if 97 <= base <= 122 else 27 + base % (space.letters - 27)
    return out


class Profiler:
    """Counts of letter n-grams, and the vectors that they bind to."""

    def __init__(self, space: Space):
        self.space = space
        self.codes = _letter_codes(space)
        self.table = space.table()

    def letters(self, bytes_: np.ndarray) -> np.ndarray:
        """The code of every character of whole UTF-8 characters; 0 is no letter."""
        cp = np.frombuffer(bytes_.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        code = np.where(cp < (1 << 16), self.codes[np.minimum(cp, 0xFFFF)], np.uint8(0))
        for i in np.flatnonzero(cp >= (1 << 16)):
            if chr(cp[i]).isalpha():
                code[i] = 27 + cp[i] % (self.space.letters - 27)
        return code

    def bind(self, code: np.ndarray) -> np.ndarray:
        """The n-gram that begins at each code, as one number."""
        g = self.space.gram
        gram = np.zeros(max(0, len(code) - g + 1), np.int64)
        for k in range(g):
            gram = gram * self.space.letters + code[k : k + len(gram)]
        return gram

    def grams(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, n-gram, whether the text has a letter): n-grams within words and across one gap."""
        n = len(offsets) - 1
        bytes_ = raw[offsets[0] : offsets[-1]]
        lead = np.flatnonzero((bytes_ & 0xC0) != 0x80)
        owner = np.searchsorted(offsets[1:] - offsets[0], lead, side="right")
        code = self.letters(bytes_)
        some = np.zeros(n, bool)
        some[owner[code > 0]] = True
        same = np.zeros(len(code), bool)
        same[1:] = owner[1:] == owner[:-1]
        keep = (code > 0) | ~same
        keep[1:] |= code[:-1] > 0  # of a run of gaps the first stays
        code, owner = code[keep], owner[keep]
        gram = self.bind(code)
        if not len(gram):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), some
        whole = owner[: len(gram)] == owner[self.space.gram - 1 :]
        return owner[: len(gram)][whole], gram[whole], some

    def long_grams(self, raw: np.ndarray) -> Iterator[tuple[np.ndarray, bool]]:
        """(n-grams, whether there is a letter) of the parts of one text; n-grams across parts included."""
        at, last, carry = 0, 1, np.zeros(0, np.uint8)
        while at < len(raw):
            stop = min(len(raw), at + PART)
            while stop < len(raw) and raw[stop] & 0xC0 == 0x80:
                stop -= 1
            code = self.letters(raw[at:stop])
            keep = code > 0
            keep[0] |= last > 0
            keep[1:] |= code[:-1] > 0
            last = int(code[-1])
            kept = np.concatenate([carry, code[keep]])
            yield self.bind(kept), bool((code > 0).any())
            carry = kept[len(kept) - min(len(kept), self.space.gram - 1) :]
            at = stop

    def bound(self, gram: np.ndarray) -> np.ndarray:
        """The vector of each n-gram: its letters' vectors, rotated by their place, multiplied."""
        out = np.ones((len(gram), self.space.dims), np.int8)
        for k in range(self.space.gram):
            letter = gram // self.space.letters ** (self.space.gram - 1 - k) % self.space.letters
            out *= np.roll(self.table, self.space.gram - 1 - k, axis=1)[letter]
        return out

    def bundle(self, rows: np.ndarray, n: int, gram: np.ndarray) -> np.ndarray:
        """The sum of the bound vectors of each of n rows; a row's n-grams must be fewer than 2 ** 24."""
        kinds, which = np.unique(gram, return_inverse=True)
        out = np.zeros((n, self.space.dims))
        for at in range(0, n, 256):
            count = min(256, n - at)
            mine = slice(*np.searchsorted(rows, [at, at + count]))
            flat = (rows[mine] - at) * len(kinds) + which[mine]
            counts = np.bincount(flat, minlength=count * len(kinds)).reshape(count, -1).astype(np.float32)
            for k in range(0, len(kinds), 4096):
                out[at : at + count] += counts[:, k : k + 4096] @ self.bound(kinds[k : k + 4096]).astype(np.float32)
        return out

    def vectors(self, column) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, bundled vectors, has a letter) for some rows at a time; sums of whole numbers, so exact."""
        raw, offsets = utf8(column)
        for a, b in chunks(offsets, PART):
            if offsets[b] - offsets[a] <= PART:
                owner, gram, some = self.grams(raw, offsets[a : b + 1])
                yield a, self.bundle(owner, b - a, gram), some
                continue
            total, some = np.zeros((1, self.space.dims)), False
            for gram, letter in self.long_grams(raw[offsets[a] : offsets[b]]):
                total += self.bundle(np.zeros(len(gram), np.int64), 1, gram)
                some |= letter
            yield a, total, np.array([some])


def prototypes(docs: DataFrame, space: Space, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """The languages of ``docs`` and the sum of the unit vectors of each one's texts.

    Tasks sum what they read: a row for each task and language, added up by Spark by language and
    dimension.  Sums are of integers (millionths), so their order does not matter.  The result has
    as many vectors as there are languages.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        profiler = Profiler(space)
        for batch in slices(batches):
            langs = np.array(batch.column(1).to_pylist(), dtype=object)
            for a, vectors, some in profiler.vectors(batch.column(0)):
                unit = np.rint(_unit(vectors) * 1e6).astype(np.int64)
                own = langs[a : a + len(vectors)]
                for name in set(own[some]):
                    sums[name] = sums.get(name, 0) + unit[some & (own == name)].sum(0)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], names=["lang", "v"])

    source = docs.where(F.col(lang).isNotNull()).select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    parts = source.mapInArrow(run, "lang string, v array<long>")
    total = parts.select("lang", F.posexplode("v").alias("d", "x")).groupBy("lang", "d").agg(F.sum("x").alias("x"))
    rows = total.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("v")).orderBy("lang").collect()
    return [r["lang"] for r in rows], np.array([[x["x"] for x in r["v"]] for r in rows], np.float64).reshape(len(rows), space.dims)


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x.astype(np.float64) ** 2).sum(1, keepdims=True))
    return x / np.where(size > 0, size, 1)


def held_out(key: str = "doc_id") -> Column:
    """The fold that training leaves out: crc32 of the key as text, modulo 4, is 2."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4)) == 2


def identify(docs: DataFrame, names: list[str], protos: np.ndarray, space: Space, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, lang_pred and score (the cosine, not below 0) for every row.

    The nearest prototype by cosine; of equals the first by name.  Null texts, texts without a
    letter, and all texts where nothing was learned: "und" and 0.  Empty table: no rows.  Text of a
    word too short for an n-gram: the first language, 0.  Other columns are ignored.
    """
    centre = _unit(protos) if len(names) else protos

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiler = Profiler(space)
        for batch in slices(batches):
            last = batch.num_columns - 1
            best = np.full(batch.num_rows, -1)
            score = np.zeros(batch.num_rows)
            if len(names):
                for a, vectors, some in profiler.vectors(batch.column(last)):
                    cosine = np.round(_unit(vectors) @ centre.T, 9)
                    top = cosine.argmax(1)
                    best[a : a + len(top)] = np.where(some, top, -1)
                    score[a : a + len(top)] = np.where(some, np.clip(cosine[np.arange(len(top)), top], 0, 1), 0)
            pred = [names[k] if k >= 0 else UNKNOWN for k in best]
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], pa.array(pred, pa.string()), pa.array(score)], names=[*batch.schema.names[:last], "lang_pred", "score"])

    source = docs.select(*keep, F.col(text).cast("string").alias("_text"))
    kinds = dict(source.dtypes)
    return source.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", lang_pred string, score double")


def language_id(docs: DataFrame, space: Space = Space(), text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """(key, held_out, lang_pred, score) for every row, learned from the rows outside the held-out fold.

    Only the text enters a prediction.  A null key is never held out.  Texts without a letter, null
    languages and nulls as in ``identify``.  Repeated rows: one each, with equal results.  A very long text
    goes through in parts of ``PART`` bytes.  Columns of any other name are ignored.
    """
    marked = docs.select(F.col(key), F.col(text), F.col(lang), F.coalesce(held_out(key), F.lit(False)).alias("held_out"))
    names, protos = prototypes(marked.where(~F.col("held_out")), space, text, lang)
    return identify(marked, names, protos, space, text, (key, "held_out"))
