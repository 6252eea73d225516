"""Chat formatting over a prefix tree.

A conversation's turns, in order of turn (then role and text), are formatted by a template, and a chain of digests names every
beginning of it. Distinct conversations in order of their chains are the leaves of the prefix tree, depth first: each shares
with the one before it the turns that their chains have in common, and only what follows is new. A pack is a stretch of that order, at
most ``PACK`` signs of new text; in it, shared turns stand once. Tokens are signs (code points): positions and intervals count these, and
a tokenizer's offsets map them to its own. A row of the result is a leaf's new text:

* ``pack``, ``start``: where it stands in its pack's stream of signs, and ``text``,
* ``position``: the position id of its first sign, which is the length of all before it in the conversation,
* ``ancestors``: the half-open intervals of the stream that it attends to besides itself, in order; neighbours are joined,
* ``loss``: the intervals of assistants' texts in it.

A pack begins with a whole conversation, so it can be trained on alone; what all packs hold is the text of the tree plus, for each pack but the first, the
turns that its first leaf shares with the leaf before. Identical conversations are one leaf (by a 128-bit keyed BLAKE2 digest, as are shared turns): they are reduced before the
exchange, so one that makes up a third of all is a row a task.

Leaves are dealt to tasks by cuts in their order, so a common first turn is split like any other. The cuts depend on nothing but the leaves: they are those whose own
hash falls into a share that makes a task hold about ``PART`` bytes, and no more than ``CUTS`` are expected (a task holds more then). A cut is a leaf's chain,
``DEEP`` turns of it at most, so leaves that share more turns than that stay together. Partitions of the input and of the session change no row.

The template: ``<|im_start|>``, role, newline, text, ``<|im_end|>``, newline. In roles and texts every backslash is doubled, and a backslash
is put after the first sign of anything that reads as a control string (``<|``, ``[INST]``, ``[/INST]``, ``<s>``, ``</s>``, ``<<SYS>>``, ``<</SYS>>``); a role's newline
is ``\\n``. ``unescaped`` undoes all of it.

Nulls: a null role or text is empty; a null turn comes first; rows without conv_id are one conversation without id. Repeated rows are repeated
turns, and turns that tie in all of turn, role and text are equal. Extra columns are not read. An empty table gives empty tables. A conversation longer than a pack is a pack of its own; it
is formatted whole, in one task.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import drop, stage

START, END = "<|im_start|>", "<|im_end|>\n"
#: The role whose texts count for the loss.
TRAINED = "assistant"
PACK = 1 << 22
#: Bytes of formatted text that a task packs, cuts expected at most, and turns of a cut.
PART, CUTS, DEEP = 64 << 20, 4096, 256
_CONTROL = re.compile(r"(<)(?=\||/?s>|</?SYS>>)|(\[)(?=/?INST\])")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)
_INTERVALS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def escaped(text: str) -> str:
    """``text`` without control strings, reversibly."""
    return _CONTROL.sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))


def unescaped(text: str) -> str:
    """What ``escaped`` was given, or a role that was."""
    return re.sub(r"\\([\\n]?)", lambda m: {"n": "\n"}.get(m[1], m[1]), text)


def formatted(turns: list[tuple[str, str]]) -> tuple[str, list[int], list[bytes], list[tuple[int, int]]]:
    """(text, ends of turns, digests of beginnings, intervals of the loss) of (role, text) turns."""
    parts, ends, chain, loss, at, last = [], [], [], [], 0, b""
    for role, text in turns:
        head, body = f"{START}{escaped(role).replace('\n', '\\n')}\n", escaped(text)
        parts += [head, body, END]
        if role == TRAINED:
            loss.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(END)
        last = hashlib.blake2b("".join((head, body)).encode(), key=last, digest_size=16).digest()
        ends.append(at)
        chain.append(last)
    return "".join(parts), ends, chain, loss


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [formatted([(t["role"], t["text"]) for t in turns]) for turns in batch.column("turns").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), pa.array([c[-1] for _, _, c, _ in got], pa.binary()), pa.array([c for _, _, c, _ in got], pa.list_(pa.binary())), pa.array([t for t, *_ in got], pa.string()),
             pa.array([e for _, e, *_ in got], pa.list_(pa.int64())), pa.array([[{"start": a, "end": b} for a, b in m] for *_, m in got], _INTERVALS)],
            ["conv_id", "leaf", "chain", "text", "ends", "loss"],
        )


def _cut(intervals: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """The first ``length`` signs of intervals."""
    out = []
    for a, b in intervals:
        if length <= 0:
            break
        out.append((a, min(b, a + length)))
        length -= b - a
    return out


def _packed(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no, stream, chain, path, own_pid = 0, 0, [], [], -1
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("pack", "start", "text", "position", "ancestors", "loss")}
            for pid, own, text, ends, loss in zip(*(batch.column(c).to_pylist() for c in ("pid", "chain", "text", "ends", "loss")), strict=True):
                k = 0
                while k < min(len(own), len(chain)) and own[k] == chain[k]:
                    k += 1
                shared = ends[k - 1] if k else 0
                if pid != own_pid or stream and stream + len(text) - shared > size:
                    no, stream, shared, path = no + 1 if pid == own_pid else 0, 0, 0, []
                before = _cut(path, shared)
                end = stream + len(text) - shared
                out["pack"].append(pid << 32 | no)
                out["start"].append(stream)
                out["text"].append(text[shared:])
                out["position"].append(shared)
                out["ancestors"].append([{"start": a, "end": b} for a, b in before])
                out["loss"].append([{"start": m["start"] - shared + stream, "end": m["end"] - shared + stream} for m in loss if m["start"] >= shared])
                path = [*before[:-1], (before[-1][0], end)] if before and before[-1][1] == stream else [*before, (stream, end)]
                stream, chain, own_pid = end, own, pid
            kinds = {"pack": pa.int64(), "start": pa.int64(), "text": pa.string(), "position": pa.int64(), "ancestors": _INTERVALS, "loss": _INTERVALS}
            yield pa.RecordBatch.from_arrays([batch.column("leaf"), *(pa.array(v, kinds[c]) for c, v in out.items())], ["leaf", *out])

    return run


def _cuts(leaves: DataFrame, part: int) -> list[bytes]:
    """Keys of the leaves that begin a task's stretch, in order."""
    size = leaves.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = min(size // part, CUTS)
    if not parts:
        return []
    n = leaves.count()
    drawn = F.conv(F.substring(F.hex("leaf"), 1, 15), 16, 10).cast("long") < int((1 << 60) * parts / n)  # digests are evenly spread
    key = F.array_join(F.transform(F.slice("chain", 1, DEEP), F.hex), "")
    return sorted({bytes.fromhex(r[0]) for r in leaves.where(drawn).select(key).collect()})  # about parts of them


def _dealt(cuts: list[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [bisect_right(cuts, b"".join(chain)) for chain in batch.column("chain").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32())], [*batch.schema.names, "pid"])

    return run


def prefix_tree(rows: DataFrame, pack: int = PACK, part: int = PART) -> tuple[DataFrame, DataFrame]:
    """Leaves (leaf, pack, start, text, position, ancestors, loss), and conversations (conv_id, leaf)."""
    turn = rows.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    turns = turn.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    spans = "array<struct<start:bigint,end:bigint>>"
    leaf = f"leaf binary, chain array<binary>, text string, ends array<bigint>, loss {spans}"
    talks = stage(turns.mapInArrow(_format, f"conv_id {kind}, {leaf}"), "talks")
    leaves = stage(talks.groupBy("leaf").agg(F.min(F.struct("chain", "text", "ends", "loss")).alias("x")).select("leaf", "x.*"), "leaves")
    cuts = _cuts(leaves, part)
    ordered = leaves.mapInArrow(_dealt(cuts), f"{leaf}, pid int").repartitionById(len(cuts) + 1, "pid").sortWithinPartitions("pid", "chain")
    tree = ordered.mapInArrow(_packed(pack), f"leaf binary, pack long, start long, text string, position long, ancestors {spans}, loss {spans}")
    tree = stage(tree, "packs")
    drop(leaves)
    return tree, talks.select("conv_id", "leaf")


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parses conversations read from their packs' streams, and the text under their loss mask."""
    pack, stream, masked, starts = None, "", [], []
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
        for no, start, text, before, mask in zip(*(batch.column(c).to_pylist() for c in ("pack", "start", "text", "ancestors", "loss")), strict=True):
            if no != pack:
                pack, stream, masked, starts = no, "", [], []
            stream += text
            masked += [(m["start"], m["end"]) for m in mask]
            starts += [m["start"] for m in mask]
            own = [*((i["start"], i["end"]) for i in before), (start, start + len(text))]
            whole = "".join([stream[a:b] for a, b in own])
            turns = [(unescaped(r), unescaped(t)) for r, t in _TURN.findall(whole)]
            loss = "".join([unescaped(stream[a:b]) for lo, hi in own for a, b in masked[bisect_left(starts, lo) : bisect_left(starts, hi)]])
            out["n_turns"].append(len(turns))
            out["turns_sha256"].append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
            out["loss_chars"].append(len(loss))
            out["loss_sha256"].append(hashlib.sha256(loss.encode()).hexdigest())
            out["formatted_chars"].append(len(whole))
        yield pa.RecordBatch.from_arrays([batch.column("leaf"), *(pa.array(v, pa.string() if k.endswith("256") else pa.int64()) for k, v in out.items())], ["leaf", *out])


def digest(tree: DataFrame, talks: DataFrame) -> DataFrame:
    """Each conversation read back from its pack by its leaf's intervals: counts and digests of its turns and of the text under the loss mask."""
    read = tree.repartition("pack").sortWithinPartitions("pack", "start").select("leaf", "pack", "start", "text", "ancestors", "loss")
    read = read.mapInArrow(_read_back, "leaf binary, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return talks.join(read, "leaf").drop("leaf")
