"""Substring deduplication of word sequences: automata of recurring phrases."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from chronofold.llm.recurrence import Batch, Units, keyed, recurring_spans, removed, unpacked, with_spans
from chronofold.llm.shared import Scratch, slices

#: Phrases in one automaton; more go to further automata, so memory is bounded.
SHARD = 20_000
#: Windows of the blocks that runs met once are cut into, and words of a cell.
FINER, CELL = (8, 1), 512


def judge(batch: Batch, units: Units, shard: int = SHARD) -> list[np.ndarray]:
    """Compile automata of the phrases that cells may hold and stream the cells through each.

    A phrase is ``window`` words in a row of what a cell meets.  Words are numbered, so a phrase is a
    sequence of numbers, and any number of words can be told apart.  A phrase knows its place, or that
    it has several; an occurrence at any other place than its own recurs.  A cell whose whole text lies
    at another place is left out.
    """
    w = units.window
    numbers: dict[bytes, int] = {}
    number = lambda text: tuple([numbers.setdefault(x, len(numbers)) for x in text.split(b" ")])
    open_ = [k for k in range(len(batch.own)) if not batch.whole(k)]
    phrases: dict[tuple, tuple | None] = {}
    for r1, r2, a, text in sorted({x for k in open_ for x in batch.partners[k]}):
        line = number(text)
        for k in range(len(line) - w + 1):
            phrase, place = line[k : k + w], (r1, r2, a + k)
            if phrases.setdefault(phrase, place) != place:
                phrases[phrase] = None
    out = [np.ones(max(0, text.count(b" ") - w + 2), bool) for *_, text in batch.own]
    lines = []
    for k in open_:
        out[k][:] = False
        lines.append(number(batch.own[k][3]))
    every = list(phrases)
    for begin in range(0, len(every), shard):
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for phrase in every[begin : begin + shard]:
            automaton.add_word(phrase, phrases[phrase])
        automaton.make_automaton()
        for k, line in zip(open_, lines, strict=True):
            r1, r2, a, _ = batch.own[k]
            for end, place in automaton.iter(line):
                if place != (r1, r2, a + end - w + 1):
                    out[k][end - w + 1] = True
    return out


def repeated_words(docs: DataFrame, scratch: Scratch, window: int = 35, text: str = "text", key: str = "doc_id", anchor: int = 8) -> DataFrame:
    """Every row of ``docs`` as (doc, packed text, spans): the words that ``window``-word sequences which start anywhere else cover.

    Words are what ASCII white space separates, unchanged; sequences stay within one text; null has
    no words; all is judged on the input.  Empty table: no rows.  Fewer words than the window: no
    spans.  Rows repeated with key and text: each is elsewhere for the other.  Very long texts: judged by
    cells of ``CELL`` words.  Other columns are ignored, whatever their names.
    """
    source = keyed(docs, text, key)
    return with_spans(source, recurring_spans(source, Units("words", window, anchor, CELL, FINER), judge, scratch))


def remove_repeated_words(docs: DataFrame, scratch: Scratch, window: int = 35, text: str = "text", key: str = "doc_id", anchor: int = 8) -> DataFrame:
    """(key, n_words, n_removed, kept) for every row; kept words are joined by one space."""
    marked = repeated_words(docs, scratch, window, text, key, anchor)
    kind = dict(marked.dtypes)["doc"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, gone, kept = [], [], []
            for text_, spans in zip(unpacked(batch.column(1)), batch.column(2), strict=True):
                words = text_.as_py().split()
                pairs = [(x["a"], x["n"]) for x in spans.as_py() or ()]
                sizes.append(len(words))
                if pairs:
                    mask = removed(len(words), pairs)
                    gone.append(int(mask.sum()))
                    words = [x for x, y in zip(words, mask.tolist(), strict=True) if not y]
                else:
                    gone.append(0)
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
                names=[key, "n_words", "n_removed", "kept"],
            )

    return marked.mapInArrow(run, f"`{key}` {kind}, n_words long, n_removed long, kept string")
