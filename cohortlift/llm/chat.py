"""Chat formatting of reply trees.

Nodes point to the node they reply to. Self-joins that double the distance they span give every node its
depth and the score of the path from its root; leaves are the branches, ranked within their tree by mean
score. The chosen leaves' paths are then listed by the same doubled steps, again in as many joins as the
logarithm of the greatest depth, and each path is formatted as one conversation.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn. Inside roles and texts a backslash is
doubled and a control string gets a backslash after its first character, so no text can end its turn and
unescaping gives the text back.

Defined results: a null text or role is empty; a node whose parent is missing is a root; nodes that a
cycle of parents holds are in no path; a node that repeats counts once, as its least row; ties in score go
to the lesser node; nodes without tree form a tree of their own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlift.llm.common import Scratch, table

START, END = "<|im_start|>", "<|im_end|>"
#: Strings that some chat template takes for control.
CONTROLS = [
    START, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
]
LOSS_ROLE = "assistant"

_SPECIAL = re.compile("|".join([r"\\", *map(re.escape, CONTROLS)]))
_ESCAPED = re.compile(r"\\(\\?)")
_ROLE_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(rf"{re.escape(START)}([^\n]*)\n(.*?){re.escape(END)}\n", re.DOTALL)


def escape(text: str) -> str:
    return _SPECIAL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return _ROLE_ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation, and the spans of it that a model is trained on."""
    out, at, loss = [], 0, []
    for role, text in turns:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        if role == LOSS_ROLE:
            loss.append((at + len(head), at + len(head) + len(body)))
        out.append(f"{head}{body}{END}\n")
        at += len(out[-1])
    return "".join(out), loss


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation; raises if anything stands outside the turns."""
    turns, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            break
        turns.append((unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"not a turn at {at}")
    return turns


# Trees


def _levels(nodes: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """Level k: (tree, node, up, n, total), ``up`` the ancestor 2**k above, over the n nodes below it.

    A level holds the nodes that had an ancestor so high in the level before; where ``up`` is null the
    root is reached, and n and total are those of the whole path.
    """
    known = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("_known"))
    first = nodes.join(known, ["tree", "parent"], "left").select(
        "tree",
        "node",
        F.when(F.col("_known"), F.col("parent")).alias("up"),
        F.lit(1).cast("bigint").alias("n"),
        F.coalesce("score", F.lit(0.0)).alias("total"),
    )
    levels = [scratch.write(first, "level_0")]
    open_before = None
    while True:
        now = levels[-1].where("up is not null")
        still_open = now.count()
        # Nodes that a cycle holds stay open for ever; of others the open ones get fewer each time.
        if still_open in (0, open_before):
            return levels
        open_before = still_open
        above = now.unionByName(_at_root(levels)).toDF("tree", "up", "up2", "n2", "total2")
        doubled = now.join(above, ["tree", "up"]).select(
            "tree",
            "node",
            F.col("up2").alias("up"),
            (F.col("n") + F.col("n2")).alias("n"),
            (F.col("total") + F.col("total2")).alias("total"),
        )
        levels.append(scratch.write(doubled, f"level_{len(levels)}"))


def _at_root(levels: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [level.where("up is null") for level in levels])


def ranked_paths(nodes: DataFrame, scratch: Scratch, top: int = 1) -> DataFrame:
    """(tree, path, rank, place, role, text) of the ``top`` branches of each tree.

    ``nodes``: tree, node, parent, role, text, score. A path is named by its leaf; place 1 is the root.
    """
    row = F.struct("parent", "role", "text", "score")
    once = nodes.groupBy("tree", "node").agg(F.min(row).alias("r")).select("tree", "node", "r.*")
    once = scratch.write(once.withColumn("tree", F.coalesce("tree", F.lit(""))), "nodes")
    levels = _levels(once, scratch)
    done = _at_root(levels)
    parents = levels[0].where("up is not null").select("tree", F.col("up").alias("node"))
    leaves = done.join(parents, ["tree", "node"], "left_anti")
    best = Window.partitionBy("tree").orderBy(F.desc(F.col("total") / F.col("n")), "node")
    chosen = leaves.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    members = scratch.write(chosen.select("tree", F.col("node").alias("path"), "rank", "node"), "leaves")
    for k in range(len(levels) - 1, -1, -1):
        up = levels[k].where("up is not null").select("tree", "node", "up")
        more = members.join(up, ["tree", "node"]).select("tree", "path", "rank", F.col("up").alias("node"))
        members = scratch.write(members.unionByName(more), f"members_{k}")
    places = done.select("tree", "node", F.col("n").alias("place"))
    return (
        members.join(places, ["tree", "node"])
        .join(once.select("tree", "node", "role", "text"), ["tree", "node"])
        .select("tree", "path", "rank", "place", "role", "text")
    )


def formatted(paths: DataFrame) -> DataFrame:
    """(tree, path, rank, text, loss) with one row for each path, its turns read in order as a stream."""
    loss_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, turns = None, []

        def whole() -> pa.RecordBatch:
            text, loss = format_turns(turns)
            spans = [{"start": a, "end": b} for a, b in loss]
            arrays = [[key[0]], [key[1]], [key[2]], pa.array([text]), pa.array([spans], loss_type)]
            kinds = [pa.string(), pa.int64(), pa.int32()]
            arrays[:3] = [pa.array(x, k) for x, k in zip(arrays[:3], kinds, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=["tree", "path", "rank", "text", "loss"])

        for batch in batches:
            for tree, path, rank, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if turns and key[:2] != (tree, path):
                    yield whole()
                    turns = []
                key = (tree, path, rank)
                turns.append((role, text))
        if turns:
            yield whole()

    in_order = (
        paths.repartition("tree", "path")
        .sortWithinPartitions("tree", "path", "place")
        .select(
            "tree", "path", "rank",
            F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        )
    )
    schema = "tree string, path bigint, rank int, text string, loss array<struct<start:bigint,end:bigint>>"
    return in_order.mapInArrow(run, schema)


def read_back(conversations: DataFrame) -> DataFrame:
    """Counts and digests of the turns and of the text under the loss mask."""
    names = ["tree", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def digest(text: str) -> str:
        return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()

    def one(tree: str, text: str, loss: list[dict]) -> tuple:
        turns = read_turns(text)
        kept = "".join(unescape(text[s["start"] : s["end"]]) for s in loss)
        said = "".join(f"{role}\n{t}\n" for role, t in turns)
        return tree, len(turns), digest(said), len(kept), digest(kept), len(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(*r) for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            arrays = [pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = (
        "tree string, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
        "formatted_chars bigint"
    )
    return conversations.select("tree", "text", "loss").mapInArrow(run, schema)


def as_tree(conversations: DataFrame) -> DataFrame:
    """Conversations as trees of one branch: each turn replies to the one before it."""
    by_turn = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = conversations.select("conv_id", "role", "text", F.row_number().over(by_turn).alias("node"))
    return numbered.select(
        F.col("conv_id").cast("string").alias("tree"),
        F.col("node").cast("bigint").alias("node"),
        F.when(F.col("node") > 1, F.col("node") - 1).cast("bigint").alias("parent"),
        "role",
        "text",
        F.lit(0.0).alias("score"),
    )


PROBE = "</s>[INST] ok [/INST]"


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted, written and read back."""
    scratch = Scratch(spark, "op6")
    probe = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE).alias("text"),
    )
    talks = table(spark, sf_dir, "conversations").select(*probe.columns).unionByName(probe)
    written = scratch.write(formatted(ranked_paths(as_tree(talks), scratch)), "formatted")
    found = read_back(written)
    return found.select(F.expr("try_cast(tree as bigint)").alias("conv_id"), *found.columns[1:])


_ESCAPES = r"\\|<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>"

OP6_SQL = rf"""
WITH talks AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}'
), sized AS (
  SELECT *, length(regexp_replace(text, '({_ESCAPES})', '\1#', 'g'))
    + length(regexp_replace(role, '({_ESCAPES}|\n)', '\1#', 'g'))
    + {len(START) + len(END) + 2} AS chars
  FROM talks
)
SELECT conv_id,
  count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = '{LOSS_ROLE}'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = '{LOSS_ROLE}'), ''))
    AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
