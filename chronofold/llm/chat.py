"""Chat formatting: conversations as prefix trees, shared turns emitted once."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm.bpe import VOCABULARY, Codec, codec
from chronofold.llm.shared import slices

START, END = "<|im_start|>", "<|im_end|>"
LEARNED = "assistant"


def escape(text: str) -> str:
    """One backslash more between every "<" and "|" that only backslashes part: no control string is left."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(role: str, text: str) -> tuple[str, str, str]:
    """The marks before, the escaped text, and the marks after it."""
    return f"{START}{escape_role(role)}\n", escape(text), f"{END}\n"


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    out = []
    at = 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError("a turn must begin with its mark")
        head = formatted.index("\n", at)
        tail = formatted.index(f"{END}\n", head + 1)
        out.append((unescape_role(formatted[at + len(START) : head]), unescape(formatted[head + 1 : tail])))
        at = tail + len(END) + 1
    return out


@dataclass
class Sample:
    """One training sequence: a prefix tree of turns, depth first.

    A node is a turn: its tokens [start, stop), of which [learn, learned) carry loss, its parent
    (-1: none) and the position of its first token, which is where its parent's end.
    """

    ids: list[int] = field(default_factory=list)
    positions: list[int] = field(default_factory=list)
    nodes: list[tuple[int, int, int, int, int]] = field(default_factory=list)  # parent, start, stop, learn, learned
    ends: list[tuple[object, int, int]] = field(default_factory=list)  # conversation, part, its last node

    def add(self, parent: int, role: str, text: str, c: Codec) -> int:
        head, body, tail = (c.encode(x) for x in render(role, text))
        start = len(self.ids)
        first = 0 if parent < 0 else self.positions[self.nodes[parent][2] - 1] + 1
        self.ids += head + body + tail
        self.positions += range(first, first + len(self.ids) - start)
        learn = start + len(head)
        self.nodes.append((parent, start, len(self.ids), learn, learn + len(body) if role == LEARNED else learn))
        return len(self.nodes) - 1

    def intervals(self) -> list[list[tuple[int, int]]]:
        """For each node the token intervals that its tokens may attend to: its ancestors' and, causally, its own."""
        out: list[list[tuple[int, int]]] = []
        for parent, start, stop, _, _ in self.nodes:
            seen = [] if parent < 0 else list(out[parent])
            if seen and seen[-1][1] == start:
                seen[-1] = (seen[-1][0], stop)
            else:
                seen.append((start, stop))
            out.append(seen)
        return out


_NODE = pa.struct([(k, pa.int32()) for k in ("parent", "start", "stop", "learn", "learned")] + [("attend", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))])
_SAMPLE = (
    "ids array<int>, positions array<int>, "
    "nodes array<struct<parent:int,start:int,stop:int,learn:int,learned:int,attend:array<struct<start:int,stop:int>>>>, "
    "ends array<struct<conversation:{kind},part:bigint,node:int>>"
)
_TURN = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))


def parts(turns: DataFrame, part_bytes: int, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """(conversation, part, turns, path) of every conversation, in parts of at most ``part_bytes`` of text.

    Turns are sorted by ranges of conversation and turn, so a conversation that holds a third of all rows
    is dealt to many tasks, and a task streams its turns without holding more than a part.  A part ends
    at ``part_bytes`` (a longer turn has a part of its own), with its conversation, and at the end of a
    range.  Parts of a conversation rise in its order; most conversations have one.
    """
    kind = dict(turns.dtypes)[conversation]
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select(F.col(conversation).alias("conversation"), F.col(turn).alias("turn"), blank(role).alias("role"), blank(text).alias("text"))
    # Equal rows may come in any order; the number only lets a range end between them.
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    order = ["conversation", "turn", "role", "text", "row"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conversation", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        id_type: list[pa.DataType] = []
        done: list[tuple] = []
        now: list[tuple[str, str]] = []
        owner, size, held, k = None, 0, 0, 0

        def flush() -> pa.RecordBatch:
            said = pa.array([[{"role": r, "text": t} for r, t in x[2]] for x in done], _TURN)
            path = ["".join(_sha(f"{len(r)}:{r}{t}")[:32] for r, t in x[2]) for x in done]
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], id_type[0]), pa.array([x[1] for x in done], pa.int64()), said, pa.array(path)], names=["conversation", "part", "turns", "path"])

        for batch in slices(batches):
            id_type[:] = [batch.schema.field("conversation").type]
            for c, r, t in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                more = len(r.encode()) + len(t.encode())
                if now and (c != owner or size + more > part_bytes):
                    done.append((owner, first + k, now))
                    k, held, now, size = k + 1, held + size, [], 0
                    if held >= (4 << 20):
                        yield flush()
                        done, held = [], 0
                owner, size = c, size + more
                now.append((r, t))
        if now:
            done.append((owner, first + k, now))
            yield flush()

    return rows.mapInArrow(run, f"conversation {kind}, part long, turns array<struct<role:string,text:string>>, path string")


def format_conversations(
    turns: DataFrame, path: str = VOCABULARY, max_tokens: int = 1 << 16, max_conversations: int = 4096, part_bytes: int = 1 << 20,
    conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """Samples (ids, positions, nodes, ends) that hold every conversation of ``turns``.

    Conversations are sorted by the digests of their turns, so those that share first turns are
    neighbours and a tree's nodes come depth first.  Sorting is by ranges of the whole path and the
    conversation, so neither a first turn nor a whole conversation that very many share makes a
    large task.  A sample is closed at ``max_tokens`` or ``max_conversations``, and at the end of a
    range; only there are shared turns emitted again.

    A conversation of more than ``part_bytes`` (or one that lies on the edge of two ranges) comes as
    several branches, one for each of its parts in order; positions begin anew with a part.

    Null role or text: empty.  Equal turn numbers: in order of role and text.  Repeated rows: turns
    of their own.  A null conversation id is one conversation, however long.  Empty table: no rows.
    Other columns are ignored, whatever their names.
    """
    kind = dict(turns.dtypes)[conversation]
    rows = parts(turns, part_bytes, conversation, turn, role, text)
    rows = rows.repartitionByRange("path", "conversation", "part").sortWithinPartitions("path", "conversation", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        sample, stack, last = Sample(), [], []
        id_type: list[pa.DataType] = []

        def close() -> pa.RecordBatch:
            nodes = [
                dict(zip(("parent", "start", "stop", "learn", "learned"), n, strict=True)) | {"attend": [{"start": a, "stop": b} for a, b in seen]}
                for n, seen in zip(sample.nodes, sample.intervals(), strict=True)
            ]
            ends = pa.struct([("conversation", id_type[0]), ("part", pa.int64()), ("node", pa.int32())])
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([sample.ids], pa.list_(pa.int32())), pa.array([sample.positions], pa.list_(pa.int32())),
                    pa.array([nodes], pa.list_(_NODE)),
                    pa.array([[{"conversation": x, "part": k, "node": n} for x, k, n in sample.ends]], pa.list_(ends)),
                ],
                names=["ids", "positions", "nodes", "ends"],
            )

        for batch in slices(batches):
            id_type[:] = [batch.schema.field("conversation").type]
            for k in range(batch.num_rows):
                own = [(x["role"], x["text"]) for x in batch.column(2)[k].as_py()]
                if sample.ends and (len(sample.ids) >= max_tokens or len(sample.ends) >= max_conversations):
                    yield close()
                    sample, stack, last = Sample(), [], []
                shared = 0
                while shared < min(len(own), len(last)) and own[shared] == last[shared]:
                    shared += 1
                del stack[shared:]
                for r, t in own[shared:]:
                    stack.append(sample.add(stack[-1] if stack else -1, r, t, c))
                last = own
                sample.ends.append((batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), stack[-1]))
        if sample.ends:
            yield close()

    return rows.select("conversation", "part", "turns").mapInArrow(run, _SAMPLE.format(kind=kind))


def read_back(samples: DataFrame, path: str = VOCABULARY, conversation: str = "conv_id") -> DataFrame:
    """What each conversation of the samples says: its tokens are those its last nodes attend to.

    Columns: conversation, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.  The parts of a
    conversation are read in their order, one at a time, into running digests.
    """
    kind = re.search(r"conversation:([^,]+(?:\([^)]*\))?),part", dict(samples.dtypes)["ends"])[1]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in slices(batches):
            for ids, nodes, ends in zip(batch.column(0), batch.column(2), batch.column(3), strict=True):
                ids, nodes = ids.as_py(), nodes.as_py()
                out: list[tuple] = []
                for end in ends.as_py():
                    spans = nodes[end["node"]]["attend"]
                    formatted = c.decode_bytes([x for s in spans for x in ids[s["start"] : s["stop"]]]).decode()
                    turns = parse(formatted)
                    chain, at = [], end["node"]
                    while at >= 0:
                        chain.append(nodes[at])
                        at = nodes[at]["parent"]
                    loss = "".join(unescape(c.decode_bytes(ids[n["learn"] : n["learned"]]).decode()) for n in reversed(chain))
                    out.append((end["conversation"], end["part"], len(turns), "".join(f"{r}\n{t}\n" for r, t in turns), loss, len(formatted)))
                cols = list(zip(*out, strict=True))
                kinds = [batch.schema.field("ends").type.value_type.field("conversation").type, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds, strict=True)], names=["conversation", "part", "n", "said", "loss", "chars"])

    said = samples.mapInArrow(read, f"conversation {kind}, part long, n long, said string, loss string, chars long")
    said = said.repartition("conversation").sortWithinPartitions("conversation", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_type: list[pa.DataType] = []
        now: list | None = None

        def flush(out: list) -> pa.RecordBatch:
            rows = [(x[0], x[1], x[2].hexdigest(), x[3], x[4].hexdigest(), x[5]) for x in out]
            kinds = [id_type[0], pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays(columns, names=[conversation, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in slices(batches):
            id_type[:] = [batch.schema.field("conversation").type]
            out = []
            for c, _, n, text, loss, chars in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if now is None or c != now[0]:
                    if now is not None:
                        out.append(now)
                    now = [c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                now[2].update(text.encode())
                now[4].update(loss.encode())
                now[1], now[3], now[5] = now[1] + n, now[3] + len(loss), now[5] + chars
            if out:
                yield flush(out)
        if now is not None:
            yield flush([now])

    schema = f"`{conversation}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return said.mapInArrow(run, schema)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
