"""Merkle manifest of a dataset by a butterfly exchange.

The rows of a group, in order, are the leaves of one tree; the roots of the groups, in order, are the leaves of the tree
above. A partition is an aligned block of ``block`` leaves (a power of the fanout). It hashes its own subtree, and then no
partition is above another: in round r the aligned runs of ``fanout`` subtrees that each span fanout^r blocks swap their
roots, block by block, and every block hashes the common ancestor for itself. After the last round each block holds the
root and all upper siblings of its leaves; nothing is sent down.

A message of a round is one root of 64 characters. Blocks of a ragged last run get what a missing partner would have sent
from the partners that are there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import materialise, shuffle_partitions

STEPS = "array<struct<left:string,right:string>>"
BLOCK_LEAVES = 1024
ROUNDS_A_PLAN = 8       # rounds of one Spark plan; then its small result is written and read again
_PROOF = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
_STATE = ["grp", "block", "blocks", "leaves", "node", "steps"]


def field_text(*cols: F.Column) -> F.Column:
    """The columns' values, each ``-`` if null, else its UTF-8 byte count, ``:`` and the value."""
    def one(c: F.Column) -> F.Column:
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))
    return F.concat(*[one(c) for c in cols])


def digest(text: F.Column) -> F.Column:
    """Lower-case hex SHA-256 of the UTF-8 text."""
    return F.sha2(F.encode(text, "UTF-8"), 256)


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _levels(leaves: list[str], fanout: int, height: int) -> list[list[str]]:
    """The leaves and the ``height`` levels above them; a last run may be shorter, even one node."""
    out = [leaves]
    for _ in range(height):
        below = out[-1]
        out.append([_hash("".join(below[i:i + fanout])) for i in range(0, len(below), fanout)])
    return out


def _tree_height(leaves: int, fanout: int) -> int:
    """Levels above the leaves until one node remains."""
    height, span = 0, 1
    while span < leaves:
        span, height = span * fanout, height + 1
    return height


def _own_height(leaves: int, block: int, fanout: int) -> int:
    """Levels that a block of a tree of so many leaves hashes by itself."""
    return _tree_height(min(leaves, block), fanout)


def numbered(rows: DataFrame, group: F.Column, order: list[F.Column], name: str) -> DataFrame:
    """rows plus (grp, pos, leaves): the row's group numbered in group order (null first), its place there from 0, the
    group's size. One range exchange of the rows; a group of any size spreads over tasks by its order, and rows equal in
    all keys by a seeded number."""
    spark = rows.sparkSession
    parts = shuffle_partitions(spark)
    # a Spark sort puts null first and compares strings by their UTF-8 bytes
    keyed = rows.select(F.struct(*rows.columns).alias("row"), group.alias("of"),
                        *[c.alias(f"o{i}") for i, c in enumerate(order)], F.rand(17).alias("tie"))
    keys = ["of", *[f"o{i}" for i in range(len(order))], "tie"]
    dealt = keyed.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    ids = materialise(dealt.select("row", "of", F.monotonically_increasing_id().alias("at")), name)
    part = F.shiftright("at", 33)
    runs = ids.groupBy("of", part.alias("part")).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    # a row for each task and group that meet: no more than tasks and groups together
    whole = Window.partitionBy("of")
    runs = runs.select("of", "part", "first", F.min("first").over(whole).alias("grp"), F.sum("n").over(whole).alias("leaves"),
                       (F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    runs = runs.withColumnsRenamed({"of": "run_of", "part": "run_part"})
    joined = ids.join(runs, F.col("of").eqNullSafe(F.col("run_of")) & (part == F.col("run_part")))
    return joined.select("row.*", "grp", (F.col("before") + F.col("at") - F.col("first")).alias("pos"), "leaves")


def _block_roots(block: int, fanout: int) -> Callable[[pa.Table], pa.Table]:
    def run(t: pa.Table) -> pa.Table:
        grp, number, leaves = (t.column(c)[0].as_py() for c in ("grp", "block", "leaves"))
        t = t.sort_by("pos")
        node = _levels(t.column("leaf").to_pylist(), fanout, _own_height(leaves, block, fanout))[-1][0]
        return pa.table({"grp": [grp], "block": [number], "leaves": [leaves], "node": [node]})
    return run


def _with_proofs(block: int, fanout: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(leaves: pa.Table, above: pa.Table) -> pa.Table:
        upper = above.column("steps")[0].as_py()
        leaves = leaves.sort_by("pos")
        height = _own_height(leaves.column("leaves")[0].as_py(), block, fanout)
        levels = _levels(leaves.column("leaf").to_pylist(), fanout, height)
        proofs = []
        for i in range(len(leaves)):
            steps, at = [], i
            for level in levels[:height]:
                run_start = at - at % fanout
                steps.append({"left": "".join(level[run_start:at]), "right": "".join(level[at + 1:run_start + fanout])})
                at //= fanout
            proofs.append(steps + upper)
        out = leaves.drop_columns(["block"])
        for name in ("subroot", "root"):
            out = out.append_column(name, pa.array([above.column(name)[0].as_py()] * len(out), pa.string()))
        return out.append_column("proof", pa.array(proofs, _PROOF))
    return run


def _round(state: DataFrame, fanout: int, span: int) -> DataFrame:
    """One exchange: runs of ``fanout`` subtrees of ``span`` blocks each swap their roots. A block sends its subtree's root
    to itself and, in each other subtree of its run, to the blocks with its own number there; where its own subtree is
    the ragged last one, also to those that find no partner of their number in it."""
    run_first = F.col("block") - F.col("block") % (fanout * span)
    run_end = F.least(run_first + fanout * span, F.col("blocks"))
    child = F.floor((F.col("block") - run_first) / span)
    mine = run_first + child * span                                     # first block of the own subtree
    number = F.col("block") - mine
    size = F.least(F.lit(span), F.col("blocks") - mine)                 # blocks of the own subtree
    active = F.col("blocks") > span
    # blocks of the run that ask this one: in the own subtree itself alone, elsewhere those whose number modulo the
    # size of this subtree is this block's number
    elsewhere = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(fanout - 1)), lambda c: F.when(
        (c != child) & (run_first + c * span + number < run_end),
        F.sequence(run_first + c * span + number, F.least(run_first + (c + 1) * span, run_end) - 1, size)).otherwise(F.array().cast("array<bigint>"))))
    to = F.when(active, F.concat(F.array("block"), elsewhere)).otherwise(F.array("block"))
    sent = state.withColumn("child", child).withColumn("to", F.explode(to)).select(
        "grp", F.col("to").alias("block"), "blocks", "leaves", "child", "node", (F.col("to") == F.col("block")).alias("own"),
        F.when(F.col("to") == F.col("block"), F.col("steps")).alias("steps"))
    met = sent.groupBy("grp", "block", "blocks", "leaves").agg(          # at most fanout messages
        F.sort_array(F.collect_list(F.struct("child", "node"))).alias("nodes"),
        F.max(F.when(F.col("own"), F.col("child"))).alias("child"), F.first("steps", ignorenulls=True).alias("steps"))

    def joined(keep: Callable[[F.Column], F.Column]) -> F.Column:
        return F.array_join(F.transform(F.filter("nodes", keep), lambda x: x["node"]), "")

    step = F.struct(joined(lambda x: x["child"] < F.col("child")).alias("left"), joined(lambda x: x["child"] > F.col("child")).alias("right"))
    busy = F.col("blocks") > span
    return met.select("grp", "block", "blocks", "leaves",
                      F.when(busy, digest(joined(lambda x: F.lit(True)))).otherwise(F.col("nodes")[0]["node"]).alias("node"),
                      F.when(busy, F.concat("steps", F.array(step))).otherwise(F.col("steps")).alias("steps"))


def butterfly(state: DataFrame, fanout: int, most_blocks: int) -> DataFrame:
    """state(grp, block, blocks, leaves, node, steps) after all rounds: node is the root of the block's tree and steps are
    its siblings from the block up, known to every block."""
    span, done = 1, 0
    while span < most_blocks:
        state = _round(state, fanout, span)
        span, done = span * fanout, done + 1
        if done % ROUNDS_A_PLAN == 0:
            state = materialise(state, "butterfly")
    return state


def _blocks(leaves: DataFrame, fanout: int, block: int, name: str) -> DataFrame:
    """The state of every block of (grp, pos, leaves, leaf) after the exchange."""
    cut = leaves.select("grp", F.floor(F.col("pos") / block).alias("block"), "pos", "leaves", "leaf")
    roots = cut.groupBy("grp", "block").applyInArrow(_block_roots(block, fanout), "grp long, block long, leaves long, node string")
    blocks = F.ceil(F.col("leaves") / block)
    state = materialise(roots.select("grp", "block", blocks.alias("blocks"), "leaves", "node",
                                     F.array().cast(STEPS).alias("steps")), name)
    most = state.agg(F.max("blocks")).first()[0] or 0
    return butterfly(state, fanout, most).select(*_STATE)


def manifest(rows: DataFrame, leaf: str, group: str, order: list[str], fanout: int = 2, block: int = BLOCK_LEAVES) -> DataFrame:
    """The rows plus (subroot, root, proof): the root of the row's group, the root over all groups, and the row's siblings
    level by level up to the root, as (left, right) texts of joined hex digests.

    Every ``fanout`` consecutive nodes become their SHA-256, a shorter last run too, until one node remains; a lone leaf
    is its tree's root. Groups stand in ascending order (null first, UTF-8 bytewise), rows by ``order`` (nulls first) and
    then by their leaf, so the roots do not depend on partitions. Repeated rows are leaves each. An empty table gives no
    rows. Input columns named like a result are replaced; others are carried along. ``block`` must be a power of fanout."""
    if fanout < 2 or fanout ** _tree_height(block, fanout) != block:
        raise ValueError("block must be a power of the fanout, and the fanout 2 or more")
    names = [c for c in rows.columns if c not in ("subroot", "root", "proof")]
    inner = F.struct(*[F.col(c) for c in names]).alias("payload")
    base = rows.select(inner, F.col(leaf).alias("leaf"))
    leaves = numbered(base, F.col("payload")[group], [*[F.col("payload")[c] for c in order], F.col("leaf")], "leaves")
    lower = materialise(_blocks(leaves, fanout, block, "blocks"), "lower")

    subroots = lower.where(F.col("block") == 0).select(F.col("grp").alias("of"), F.col("node").alias("leaf"))
    tops = numbered(subroots, F.lit(0), [F.col("of")], "subroots")
    top_blocks = _blocks(tops, fanout, block, "tops").withColumnRenamed("node", "root")
    top = _proofs(tops, top_blocks.withColumn("subroot", F.col("root")), block, fanout).select(
        F.col("of").alias("top_of"), "root", F.col("proof").alias("top_steps"))

    above = lower.join(top, F.col("grp") == F.col("top_of")).select(
        "grp", "block", F.col("node").alias("subroot"), "root", F.concat("steps", "top_steps").alias("steps"))
    return _proofs(leaves, above, block, fanout).select("payload.*", "subroot", "root", "proof")


def _proofs(leaves: DataFrame, above: DataFrame, block: int, fanout: int) -> DataFrame:
    """leaves plus (subroot, root, proof), each block with what it has acquired."""
    schema = leaves.select("*", F.lit("").alias("subroot"), F.lit("").alias("root"), F.array().cast(STEPS).alias("proof")).schema
    cut = leaves.withColumn("block", F.floor(F.col("pos") / block))
    known = above.select("grp", "block", "subroot", "root", "steps")
    return (cut.groupBy("grp", "block").cogroup(known.groupBy("grp", "block"))
            .applyInArrow(_with_proofs(block, fanout), schema))


def fold(leaf: F.Column, proof: F.Column) -> F.Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(proof, leaf, lambda node, s: digest(F.concat(s["left"], node, s["right"])))


def siblings_digest(proof: F.Column) -> F.Column:
    """SHA-256 of all siblings, level by level from the leaf up, left to right."""
    return digest(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""))
