"""Chat formatting as prefix trees.

Conversations that share their first turns are merged: sorted by the hashes of their
turns, those with a common beginning stand side by side, and each task writes them as
trees, depth first. A turn that several conversations share is written once; every turn
carries the position of its first character on its own path and the intervals of its
ancestors in the written text, which together with its own are all it attends to. A
tree is cut into sequences of bounded length; only the path that leads to the cut is
written again. The unit of all places is the code point.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The marks of a turn.
START, END = "<|im_start|>", "<|im_end|>\n"
LEARNED_ROLE = "assistant"
# A sequence is closed when it reaches this length; one conversation may be longer.
SEQUENCE_CHARACTERS = 32_768

_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """The text without "<|": one backslash goes between, so `unescape` gives the text back."""
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m.group(1) == "n" else m.group(1), unescape(role))


@dataclass
class _Sequence:
    parts: list[str] = field(default_factory=list)
    length: int = 0
    nodes: list[dict] = field(default_factory=list)
    leaves: list[dict] = field(default_factory=list)
    path: list[tuple] = field(default_factory=list)  # turns and node numbers of the last conversation

    def add(self, conversation: int | None, turns: list[tuple[str, str]]) -> None:
        shared = 0
        while shared < min(len(turns), len(self.path)) and self.path[shared][0] == turns[shared]:
            shared += 1
        del self.path[shared:]
        for turn in turns[shared:]:
            role, text = turn
            head = f"{START}{escape_role(role)}\n"
            body = escape(text)
            parent = self.path[-1][1] if self.path else -1
            above = self.nodes[parent] if self.path else None
            node = {
                "parent": parent,
                "start": self.length,
                "end": self.length + len(head) + len(body) + len(END),
                "position": above["position"] + above["end"] - above["start"] if above else 0,
                "ancestors": [*above["ancestors"], {"start": above["start"], "end": above["end"]}] if above else [],
                "loss": [{"start": self.length + len(head), "end": self.length + len(head) + len(body)}] if role == LEARNED_ROLE and body else [],
            }
            # Neighbours in place are one interval.
            if len(node["ancestors"]) > 1 and node["ancestors"][-2]["end"] == node["ancestors"][-1]["start"]:
                last = node["ancestors"].pop()
                node["ancestors"][-1] = {"start": node["ancestors"][-1]["start"], "end": last["end"]}
            self.parts += [head, body, END]
            self.length = node["end"]
            self.nodes.append(node)
            self.path.append((turn, len(self.nodes) - 1))
        self.leaves.append({"conv_id": conversation, "node": self.path[-1][1]})


_INTERVALS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_SCHEMA = pa.schema(
    [
        ("sequence_id", pa.int64()),
        ("text", pa.string()),
        ("nodes", pa.list_(pa.struct([("parent", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("position", pa.int64()), ("ancestors", _INTERVALS), ("loss", _INTERVALS)]))),
        ("leaves", pa.list_(pa.struct([("conv_id", pa.int64()), ("node", pa.int64())]))),
    ]
)
_SPANS = "array<struct<start:long,end:long>>"
SEQUENCES = f"sequence_id long, text string, nodes array<struct<parent:long,start:long,end:long,position:long,ancestors:{_SPANS},loss:{_SPANS}>>, leaves array<struct<conv_id:long,node:long>>"


def _writer(limit: int) -> Callable:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, now = TaskContext.get().partitionId() << 32, _Sequence()

        def done() -> pa.RecordBatch:
            row = {"sequence_id": number, "text": "".join(now.parts), "nodes": now.nodes, "leaves": now.leaves}
            return pa.RecordBatch.from_pylist([row], schema=_SCHEMA)

        for batch in batches:
            for i in range(len(batch)):
                turns = [(t["role"] or "", t["text"] or "") for t in batch["turns"][i].as_py()]
                now.add(batch["conv_id"][i].as_py(), turns)
                if now.length >= limit or len(now.leaves) >= limit:
                    yield done()
                    number, now = number + 1, _Sequence()
        if now.leaves:
            yield done()

    return write


def format_conversations(turns: DataFrame, characters: int = SEQUENCE_CHARACTERS) -> DataFrame:
    """Sequences of merged conversations: sequence_id, text, nodes in depth-first order, and leaves.

    Reads conv_id, turn, role and text; other columns are left aside. A conversation's
    rows are taken by turn, ties by role and text, repeated rows and all; null roles
    and texts count as empty, a null turn comes first, and rows with a null conv_id are
    one conversation. A node is one turn: its parent (-1 for none), its interval of the
    text, the position of its start on its path, its ancestors' intervals, and the
    intervals to learn from (the text of an assistant's turn). A leaf names a
    conversation and its last node. An empty table gives no rows.

    One conversation is held by one task at a time. Equal conversations may lie on
    several tasks, as their ids spread them.
    """
    typed = turns.select(*(F.col(c).cast(t).alias(c) for c, t in (("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"))))
    whole = typed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    keyed = whole.withColumn("path", F.transform("turns", lambda t: F.xxhash64(F.coalesce(t["role"], F.lit("")), F.coalesce(t["text"], F.lit("")))))
    lined = keyed.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    return lined.select("conv_id", "turns").mapInArrow(_writer(characters), SEQUENCES)


def read_back(text: str, spans: list[tuple[int, int]]) -> list[tuple[str, str]]:
    """Turns (role, text) written in the spans of a sequence's text."""
    written = "".join(text[a:b] for a, b in spans)
    turns = []
    at = 0
    while at < len(written):
        line = written.index("\n", at)
        stop = written.index(END, line)
        turns.append((unescape_role(written[at + len(START) : line]), unescape(written[line + 1 : stop])))
        at = stop + len(END)
    return turns


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    for batch in batches:
        columns: list[list] = [[] for _ in names]
        for i in range(len(batch)):
            text, nodes, leaves = (batch[c][i].as_py() for c in ("text", "nodes", "leaves"))
            for leaf in leaves:
                node = nodes[leaf["node"]]
                spans = [(s["start"], s["end"]) for s in node["ancestors"]] + [(node["start"], node["end"])]
                turns = read_back(text, spans)
                loss, at = [], leaf["node"]
                while at >= 0:
                    loss += [unescape(text[s["start"] : s["end"]]) for s in reversed(nodes[at]["loss"])]
                    at = nodes[at]["parent"]
                learned = "".join(reversed(loss))
                told = "".join(f"{role}\n{said}\n" for role, said in turns)
                values = (leaf["conv_id"], len(turns), _sha(told), len(learned), _sha(learned), sum(b - a for a, b in spans))
                for column, value in zip(columns, values):
                    column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def digests(sequences: DataFrame) -> DataFrame:
    """Per conversation, as read back from its sequence: turns, their digest, the text to learn from, its digest, and its formatted length."""
    return sequences.select("text", "nodes", "leaves").mapInArrow(
        _digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
