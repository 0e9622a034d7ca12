"""Reply trees as conversations: paths by self-joins, ranked branches, a reversible format."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import written

START, END = "<|im_start|>", "<|im_end|>"
LEARNED = "assistant"
TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.DOTALL)


def escape(text: str) -> str:
    """No control string is left: a backslash parts ``<`` and ``|``."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def _escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def _unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.DOTALL)


def reply_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """``tree, leaf, rank, up, node``: the best root-to-leaf paths of each tree.

    ``nodes``: tree, node, parent, score; node names are unique over all trees, a root
    has no parent. Paths are enumerated by joining jumps of doubling length, so a chain
    of n replies takes about log2(n) joins. A branch's score is the sum over its nodes
    (null counts 0); ties go to the leaf that sorts first. ``up`` is the distance to the
    leaf. A node whose parent is missing counts as a root; nodes that only lead into a
    circle have no root and give no path.
    """
    linked = nodes.select("node", F.col("parent").alias("to")).where("to is not null")
    known = nodes.select(F.col("node").alias("to"))
    jumps = [written(linked.join(known, "to", "left_semi").select("node", "to"), "jumps")]
    most = math.ceil(math.log2(max(2, nodes.count()))) + 1
    while len(jumps) <= most and not jumps[-1].isEmpty():
        onward = jumps[-1].select(F.col("node").alias("to"), F.col("to").alias("beyond"))
        jumps.append(written(jumps[-1].join(onward, "to").select("node", F.col("beyond").alias("to")), "jumps"))
    leaves = nodes.select("tree", F.col("node").alias("leaf")).join(jumps[0].select(F.col("to").alias("leaf")), "leaf", "left_anti")
    if len(jumps) > most:
        leaves = leaves.join(jumps[-1].select(F.col("node").alias("leaf")), "leaf", "left_anti")
    paths = leaves.select("tree", "leaf", F.lit(0).cast("long").alias("up"), F.col("leaf").alias("node"))
    for power in range(len(jumps) - 1, -1, -1):
        step = paths.join(jumps[power], "node").select("tree", "leaf", (F.col("up") + (1 << power)).alias("up"), F.col("to").alias("node"))
        paths = written(paths.unionByName(step), "paths")
    scored = paths.join(nodes.select("node", "score"), "node")
    scored = scored.groupBy("tree", "leaf").agg(F.sum(F.coalesce("score", F.lit(0.0))).alias("score"))
    order = Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= branches)
    return paths.join(best.select("leaf", "rank"), "leaf").select("tree", "leaf", "rank", "up", "node")


def format_turns(turns) -> tuple[str, list[dict[str, int]]]:
    """One conversation as text, and the spans (in characters) that are learned from."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{_escape_role(role)}\n", escape(text)
        parts += [head, body, f"{END}\n"]
        if role == LEARNED:
            spans.append({"begin": at + len(head), "end": at + len(head) + len(body)})
        at += sum(map(len, parts[-3:]))
    return "".join(parts), spans


SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by path; one path may go over several batches."""
    now, turns, ready, size = None, [], [], 0

    def flush():
        columns = list(zip(*ready))
        kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), SPANS)
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["tree", "leaf", "rank", "formatted", "loss"])

    for batch in batches:
        for tree, leaf, rank, role, text in zip(*(batch.column(i) for i in range(5))):
            path = (tree.as_py(), leaf.as_py(), rank.as_py())
            if path != now:
                if now is not None:
                    ready.append((*now, *format_turns(turns)))
                    size += len(ready[-1][3])
                    if size > 1 << 22:
                        yield flush()
                        ready, size = [], 0
                now, turns = path, []
            turns.append((role.as_py() or "", text.as_py() or ""))
    if now is not None:
        ready.append((*now, *format_turns(turns)))
        yield flush()


def format_trees(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """``tree, leaf, rank, formatted, loss`` per chosen path of the reply trees.

    ``nodes``: tree, node, parent, score, role, text; a null role or text is empty. The
    text of a conversation is one value, so it is put together in one task, turn by turn.
    """
    narrow = nodes.select("tree", "node", "parent", "score")
    paths = reply_paths(written(narrow, "nodes"), branches)
    turns = paths.join(nodes.select("node", "role", "text"), "node")
    turns = turns.repartition("leaf").sortWithinPartitions("tree", "leaf", F.desc("up"))
    kinds = "tree string, leaf string, rank int, formatted string, loss array<struct<begin:long,end:long>>"
    return turns.select("tree", "leaf", "rank", "role", "text").mapInArrow(_format, kinds)


def chains(conversations: DataFrame) -> DataFrame:
    """Linear conversations (conv_id, turn, role, text) as trees of one branch.

    Rows go by turn (null first), rows of one turn by role and text; a missing
    conversation id is a conversation of its own. Rows are numbered within their
    conversation by a streaming sort.
    """
    rows = conversations.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("null")).alias("tree"),
        F.col("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"),
    )
    order = Window.partitionBy("tree").orderBy(*(F.asc_nulls_first(c) for c in ("turn", "role", "text")))
    rows = rows.withColumn("place", F.row_number().over(order))
    name = lambda place: F.concat_ws("/", "tree", F.lpad(place.cast("string"), 12, "0"))
    parent = F.when(F.col("place") > 1, name(F.col("place") - 1))
    return rows.select("tree", name(F.col("place")).alias("node"), parent.alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Role and text of each turn, as they were before they were formatted."""
    return [(_unescape_role(role), unescape(text)) for role, text in TURN.findall(formatted)]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for tree, formatted, loss in zip(*(batch.column(c) for c in ("tree", "formatted", "loss"))):
            tree, formatted = tree.as_py(), formatted.as_py()
            turns, learned = read_turns(formatted), "".join(unescape(formatted[s["begin"] : s["end"]]) for s in loss.as_py())
            whole = "".join(f"{role}\n{text}\n" for role, text in turns)
            out.append({
                "conv_id": None if tree == "null" else int(tree),
                "n_turns": len(turns),
                "turns_sha256": hashlib.sha256(whole.encode()).hexdigest(),
                "loss_chars": len(learned),
                "loss_sha256": hashlib.sha256(learned.encode()).hexdigest(),
                "formatted_chars": len(formatted),
            })
        if out:
            yield pa.RecordBatch.from_pylist(out)


def digest_formatted(formatted: DataFrame) -> DataFrame:
    """Counts and digests of what is read back from formatted conversations."""
    kinds = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.mapInArrow(_digests, kinds)
