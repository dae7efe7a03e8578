"""Operator 13: prefix trie of conversations, built level by level for all conversations at once.

Conversations that begin with the same turns share nodes. At each depth the live conversations are grouped by (parent node,
next turn): partial minima and counts by key, one row a node and the smallest conv_id as its name; a join gives every
conversation its node. Then the levels are walked back and each parent adds up its children's leaves and savings.

A node all of whose members go on alike to their ends (one member, or exact copies) needs no more levels: below it there is one
chain, which follows from its first member's turns and their running sums. So the number of levels is that of the
longest beginning that two different conversations share, whatever their length. "Alike" is two xors of 64-bit hashes of the
members' (place, turn) pairs, 128 bits in all, summed by partial aggregates; no conversation is gathered in a row.

Turns are compared by the SHA-256 of role and text, so no text is shuffled. Places and running sums come from range
blocks, as a conversation may hold a third of all turns. A turn that a third of all conversations begin with is a skewed key of
one join side, which Spark splits (AQE skew join). Ids of conversations that end at a node are joined in blocks of 1,024 first;
the blocks of a node are then hashed in order, one at a time.

Defined cases: null roles and texts are empty; null turns come first; turns of equal number stand in the order of their
digests, so the order of rows does not matter; repeated rows are turns of their own. Rows without a conv_id belong to no
conversation. An empty table has no conversation and so not even a root. A very long text is hashed and counted in its scan.
Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.shared import stash, table
from strandline.operators.events import positions

EMPTY = hashlib.sha256(b"").hexdigest()


def numbered_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, pos, key, size, upto): turns in order from 1, the digest and the code points of each, and their running sum."""
    blank = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    key = F.unhex(F.sha2(F.concat(F.length(blank(role)).cast("string"), F.lit(":"), blank(role), blank(text)).cast("binary"), 256))
    d = turns.select(F.col(f"`{conv}`").cast("bigint").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), key.alias("key"), F.length(blank(text)).alias("size")).where("conv_id is not null")
    d = positions(d, ["conv_id"], ["turn", "key"], F.col("size"))
    return d.selectExpr("conv_id", "cast(_pos as int) as pos", "key", "cast(size as bigint) as size", "cast(_end as bigint) as upto")


def with_shared_heads(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numbered turns in which conversation c begins with the first h turns of conversation c - c % 100 in place of its own
    first h, where h is crc32 of the decimal c, modulo 6; and all conversations (conv_id), also those left without a turn.
    The remainder of a negative id is SQL's, of its own sign."""
    turns = stash(turns, "turns")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")
    convs = turns.groupBy("conv_id").agg(F.sum(F.when(F.col("pos") <= h, F.col("size")).otherwise(0)).alias("dropped")).withColumn("h", h)
    convs = stash(convs, "conversations")
    first = turns.where("pos <= 5").withColumnRenamed("conv_id", "base")  # h is 5 at most
    heads = convs.select("conv_id", "h", (F.col("conv_id") - F.col("conv_id") % 100).alias("base")).join(first, "base").where("pos <= h")
    heads = heads.select("conv_id", "pos", "key", "size", "upto")
    shift = convs.join(heads.groupBy("conv_id").agg(F.count("*").alias("k"), F.sum("size").alias("added")), "conv_id", "left")
    shift = shift.selectExpr("conv_id", "h", "h - coalesce(k, 0) as back", "dropped - coalesce(added, 0) as less")
    tails = turns.join(shift, "conv_id").where("pos > h").selectExpr("conv_id", "cast(pos - back as int) as pos", "key", "size", "upto - less as upto")
    return heads.union(tails), convs.select("conv_id")


def _levels(turns: DataFrame, convs: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """By depth: the live conversations with their next turn (written), and the nodes they make (written).

    A node is settled if its members are alike from here on; those of a node that is not go on, while they have turns."""
    mark = lambda *c: F.bit_xor(F.xxhash64(*c))
    whole = turns.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.sum("size").alias("total"), F.struct(mark("pos", "key"), mark("key", "pos", F.lit(1))).alias("whole"))
    live = convs.join(whole, "conv_id", "left").selectExpr(
        "conv_id", "coalesce(n_turns, 0) as n_turns", "coalesce(total, 0) as total", "whole", "cast(null as bigint) as parent", "cast('' as binary) as key", "0L as size", "0L as upto"
    )
    settled = F.min("whole").eqNullSafe(F.max("whole")) & (F.min("n_turns") == F.max("n_turns"))
    largest = [F.max(c).alias(c) for c in ("size", "upto", "n_turns", "total")]  # equal for all members; of n_turns and total, if settled
    steps, nodes = [], []
    for depth in count():
        steps.append(stash(live.withColumn("depth", F.lit(depth)), "trie-step"))
        made = steps[-1].groupBy("depth", "parent", "key").agg(F.min("conv_id").alias("node"), F.count("*").alias("n_convs"), *largest, settled.alias("settled"))
        nodes.append(stash(made, "trie-nodes"))
        open_ = nodes[-1].where("not settled")
        if open_.isEmpty():
            return steps, nodes
        at = placed(steps[-1], open_).where(F.col("n_turns") > depth).select("conv_id", "n_turns", "total", "whole", F.col("node").alias("parent"))
        live = at.join(turns.where(F.col("pos") == depth + 1).select("conv_id", "key", "size", "upto"), "conv_id")


def placed(steps: DataFrame, nodes: DataFrame) -> DataFrame:
    """The conversations of steps with node and settled of the node that each is in."""
    n = nodes.select(F.col("depth").alias("_d"), F.col("parent").alias("_p"), F.col("key").alias("_k"), "node", "settled")
    return steps.join(n, (F.col("depth") == F.col("_d")) & F.col("parent").eqNullSafe(F.col("_p")) & (F.col("key") == F.col("_k"))).drop("_d", "_p", "_k")


def _rolled_up(nodes: list[DataFrame]) -> list[DataFrame]:
    """The levels with n_children, n_leaves and saved, from the deepest to the root: each adds up the level below it."""
    out: list[DataFrame] = []
    own = (F.col("n_convs") - 1) * F.col("size")
    chain = (F.col("n_convs") - 1) * (F.col("total") - F.col("upto") + F.col("size"))  # this node's turn and all after it
    for level in reversed(nodes):
        d = level
        if out:
            d = d.join(out[-1].groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("_n"), F.sum("n_leaves").alias("_l"), F.sum("saved").alias("_s")), "node", "left")
        else:
            d = d.selectExpr("*", "null as _n", "null as _l", "null as _s")
        d = d.select(
            "node", "depth", "parent", "n_convs", "n_turns", "total", "settled",
            F.when(F.col("settled"), (F.col("n_turns") > F.col("depth")).cast("bigint")).otherwise(F.coalesce("_n", F.lit(0))).cast("bigint").alias("n_children"),
            F.when(F.col("settled"), 1).otherwise(F.coalesce("_l", F.lit(1))).cast("bigint").alias("n_leaves"),
            F.when(F.col("settled"), chain).otherwise(own + F.coalesce("_s", F.lit(0))).cast("bigint").alias("saved"),
        )
        out.append(stash(d, "trie-sums"))
    return out


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (node, depth, block, ids) in order: the SHA-256 of each node's ids, block after block."""
    now, sha = None, None
    for b in batches:
        done = []
        for node, depth, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3)):
            if (node, depth) != now:
                done += [(*now, sha.hexdigest())] if now else []
                now, sha = (node, depth), hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(ids.as_py().encode())
        yield _digest_batch(done)
    if now:
        yield _digest_batch([(*now, sha.hexdigest())])


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [(), (), ()]
    return pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string())], ["node", "depth", "ends_sha256"])


def build_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row by node of the trie of convs(conv_id) over turns(conv_id, pos, key, size, upto): conv_id, depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved (over its subtree, each node's size for every member but one) and ends_sha256."""
    turns = stash(turns.repartitionByRange("pos", "conv_id").sortWithinPartitions("pos", "conv_id"), "trie-turns")  # a level reads its own files
    steps, nodes = _levels(turns, convs)
    sums = reduce(DataFrame.union, _rolled_up(nodes))
    tops = sums.where("settled and n_turns > depth").select("node", F.col("depth").alias("top"), "n_convs", "n_turns", "total")
    chains = tops.join(turns.withColumnRenamed("conv_id", "node"), "node").where(F.col("pos") > F.col("top")).select(
        "node", F.col("pos").alias("depth"), F.col("node").alias("parent"), "n_convs", (F.col("pos") < F.col("n_turns")).cast("bigint").alias("n_children"), F.lit(1).cast("bigint").alias("n_leaves"),
        ((F.col("n_convs") - 1) * (F.col("total") - F.col("upto") + F.col("size"))).alias("saved"),
    )
    every = sums.select(*chains.columns).union(chains)

    ends = placed(reduce(DataFrame.union, steps), reduce(DataFrame.union, nodes)).where(F.col("settled") | (F.col("n_turns") == F.col("depth")))
    ends = ends.groupBy("node", F.col("n_turns").cast("int").alias("depth"), F.shiftright("conv_id", 10).alias("block")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids"))
    ends = ends.repartition("node", "depth").sortWithinPartitions("node", "depth", "block").mapInArrow(_digests, "node bigint, depth int, ends_sha256 string")
    d = every.join(ends, ["node", "depth"], "left")
    return d.select(
        F.col("node").alias("conv_id"), F.col("depth").cast("bigint").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256")
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, rebuilt with shared beginnings."""
    turns, convs = with_shared_heads(numbered_turns(table(spark, sf_dir, "conversations")))
    return build_trie(turns, convs).withColumnRenamed("saved", "saved_tokens")
