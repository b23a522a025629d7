"""Operator 12: the trie of all prefixes of conversations, by ROLLUP over positional turn columns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import saved

#: Turn columns of a block; longer conversations go on in further blocks.
WIDTH = 8
#: Blocks of a conversation whose hashes are chained in one task; beyond that, sums of such stretches are chained.
STRETCH = 1024
#: A parent with this share of all nodes is hot; there are at most 1 / share of them, so they can be broadcast.
HOT_SHARE = 1e-3
_EMPTY = hashlib.sha256(b"").hexdigest()
_NODE = ("depth", "x", "y")


def turn_slot(role: Column, text: Column) -> Column:
    """Name of a turn in 16 bytes: 12 of the SHA-256 of role and text, 4 of the text's UTF-8 length. Null counts as empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    return F.unhex(F.concat(F.substring(digest, 1, 24), F.lpad(F.hex(F.octet_length(text).cast("long")), 8, "0")))


def _slot_bytes(slot: Column) -> Column:
    return F.conv(F.hex(F.substring(slot, 13, 4)), 16, 10).cast("long")


def numbered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns: conv_id, part, place, slot; parts: conv_id, part, n, before) of conversations (conv_id, turn, role, text).

    Turns are ordered by `turn`, null first, then by their slot; the number of
    a turn is `before` + `place`. A range partition by conversation and turn
    deals a long conversation over several parts. Rows without conv_id are no
    conversation's. Both tables are written to the shared folder.
    """
    known = conversations.where("conv_id is not null")
    slim = saved(known.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", turn_slot(F.col("role"), F.col("text")).alias("slot")))
    order = ["turn", "slot"]
    dealt = saved(slim.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()))
    turns = dealt.withColumn("place", F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order)).cast("long")).drop("turn")
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    return turns, saved(parts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0).cast("long"))))


def with_shared_openings(conversations: DataFrame, group: int = 5, longest: int = 8) -> tuple[DataFrame, DataFrame]:
    """(turns: conv_id, position, slot; conversations: conv_id) where each conversation opens as its group's first does.

    Conversation c takes the first h turns of c - c % group (all if fewer, none
    if absent), then its own after its first h; h = crc32(decimal c) % (longest + 1).
    """
    turns, parts = numbered_turns(conversations)
    first = F.col("conv_id") - F.col("conv_id") % group
    h = (F.crc32(F.col("conv_id").cast("string")) % (longest + 1)).alias("h")
    convs = parts.groupBy("conv_id").agg(F.sum("n").alias("n"))
    heads = convs.where(F.col("conv_id") == first).select(F.col("conv_id").alias("first"), F.col("n").alias("n_first"))
    convs = saved(convs.select("conv_id", h, first.alias("first")).join(heads, "first", "left").withColumn("taken", F.least("h", F.coalesce("n_first", F.lit(0)))))
    at = turns.join(parts.join(convs, "conv_id").select("conv_id", "part", "before", "h", "first", "taken"), ["conv_id", "part"])
    at = saved(at.select("conv_id", "first", "h", "taken", (F.col("before") + F.col("place")).alias("place"), "slot"))
    opens = F.col("conv_id") == F.col("first")
    own = at.where(opens | (F.col("place") > F.col("h"))).select("conv_id", F.when(opens, F.col("place")).otherwise(F.col("place") - F.col("h") + F.col("taken")).alias("position"), "slot")
    others = F.explode(F.sequence(F.lit(1 - group), F.lit(group - 1))).alias("step")
    lent = at.where(opens & (F.col("place") <= longest)).select(F.col("first").alias("lender"), F.col("place").alias("position"), "slot", others).where("step <> 0")
    lent = lent.withColumn("conv_id", F.col("lender") + F.col("step"))
    lent = lent.join(convs.select("conv_id", "first", "h"), "conv_id").where("first = lender and position <= h").select("conv_id", "position", "slot")
    return own.unionByName(lent), convs.select("conv_id")


def _place_hash(position: Column, slot: Column) -> tuple[Column, Column]:
    return F.xxhash64(position, slot), F.xxhash64(slot, F.lit(7), position)


def _blocks(turns: DataFrame, convs: DataFrame, width: int) -> DataFrame:
    """A row for each conversation and block of turns: s1.. (null after the last), n_slots, hash x, y of the block, and px, py of all turns before it."""
    marked = turns.select("conv_id", "position", "slot").unionByName(convs.select("conv_id", F.lit(1).cast("long").alias("position"), F.lit(None).cast("binary").alias("slot")))
    held = F.sort_array(F.collect_list(F.when(F.col("slot").isNotNull(), F.struct("position", "slot"))))
    b = marked.groupBy("conv_id", F.floor((F.col("position") - 1) / width).alias("block")).agg(held.alias("a"))
    total = lambda i: F.aggregate("a", F.lit(0).cast("long"), lambda acc, t: acc.bitwiseXOR(_place_hash(t["position"], t["slot"])[i]))
    b = b.select(
        "conv_id", "block", F.floor(F.col("block") / STRETCH).alias("stretch"), F.size("a").alias("n_slots"), total(0).alias("x"), total(1).alias("y"),
        *[F.get("a", F.lit(i))["slot"].alias(f"s{i + 1}") for i in range(width)],
    )
    b = saved(b)
    earlier = lambda w, c: F.coalesce(F.bit_xor(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    inside, across = Window.partitionBy("conv_id", "stretch").orderBy("block"), Window.partitionBy("conv_id").orderBy("stretch")
    sums = b.groupBy("conv_id", "stretch").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    sums = sums.select("conv_id", "stretch", earlier(across, "x").alias("ox"), earlier(across, "y").alias("oy")).where("stretch > 0")
    out = b.withColumn("px", earlier(inside, "x")).withColumn("py", earlier(inside, "y")).join(sums, ["conv_id", "stretch"], "left")
    chained = lambda p, o: F.col(p).bitwiseXOR(F.coalesce(o, F.lit(0).cast("long")))
    return out.withColumn("px", chained("px", "ox")).withColumn("py", chained("py", "oy")).drop("ox", "oy", "stretch")


def _rolled(rows: DataFrame, width: int, sums: str) -> DataFrame:
    """ROLLUP over the turn columns of each block: a row for each prefix, with `level`, the turns of the block in it, and `sums`."""
    slots = ", ".join(f"s{i + 1}" for i in range(width))
    found = rows.sparkSession.sql(
        f"select block, px, py, {slots}, cast({width} - bit_count(grouping_id()) as int) as level, {sums} from {{rows}} group by block, px, py, rollup({slots})", rows=rows
    )
    # a group whose last turn is null repeats the shorter prefix; a later block's level 0 is the end of the block before
    last = F.get(F.array(*[f"s{i + 1}" for i in range(width)]), F.col("level") - 1)
    return found.withColumn("last", F.when(F.col("level") > 0, last)).where("level > 0 and last is not null or level = 0 and block = 0")


def _names(rows: DataFrame, width: int) -> DataFrame:
    """Adds depth, x, y (the node's name) and up_x, up_y (its parent's)."""
    place = lambda i: F.col("block") * width + F.lit(i + 1).cast("long")

    def total(i: int, upto: Column) -> Column:
        each = [F.when(upto > k, _place_hash(place(k), F.col(f"s{k + 1}"))[i]).otherwise(F.lit(0).cast("long")) for k in range(width)]
        return reduce(lambda a, b: a.bitwiseXOR(b), each, F.col("px" if i == 0 else "py"))

    level = F.col("level")
    return rows.withColumns({
        "depth": (F.col("block") * width + level).cast("long"), "x": total(0, level), "y": total(1, level), "up_x": total(0, level - 1), "up_y": total(1, level - 1),
    })


def _looked_up(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """rows (written) left-joined with table (written, unique keys); the keys that hold HOT_SHARE of all rows are broadcast, so none of them fills a task."""
    heavy = F.col(weight) >= max(1, total * HOT_SHARE)
    hot = F.broadcast(table.where(heavy).drop(weight))
    met = rows.join(hot, keys)
    rest = rows.join(F.broadcast(table.where(heavy).select(*keys)), keys, "left_anti")
    return met.unionByName(rest.join(table.where(~heavy).drop(weight), keys, "left"))


def _below_blocks(nodes: DataFrame, last_block: int) -> DataFrame:
    """(block, x, y, below_saved, below_leaves, n_next): sums over all that hangs on the end of a full block, which is named by the next block's number.

    Each end knows the end above it. Sums double their reach in every round,
    and so do the pointers, so there are as many rounds as the logarithm of
    the number of blocks of the longest conversation.
    """
    name = ["block", "x", "y"]
    told = nodes.where("block > 0").groupBy("block", F.col("px").alias("x"), F.col("py").alias("y")).agg(
        F.sum("saved").alias("below_saved"), F.sum("leaf").alias("below_leaves"), F.sum((F.col("level") == 1).cast("long")).alias("n_next")
    )
    above = nodes.where("goes_on").select((F.col("block") + 1).alias("block"), "x", "y", F.col("block").alias("up_block"), F.col("px").alias("far_x"), F.col("py").alias("far_y"))
    ends = saved(told.join(above, name))
    far, step = ["up_block", "far_x", "far_y"], 1
    while step < last_block:
        add = ends.where("up_block > 0").groupBy(*far).agg(F.sum("below_saved").alias("add_saved"), F.sum("below_leaves").alias("add_leaves"), F.count(F.lit(1)).alias("n")).toDF(*name, "add_saved", "add_leaves", "n")
        grown = ends.join(add, name, "left")
        jumps = saved(grown.where("n is not null").select(*[F.col(c).alias(f) for c, f in zip(name, far, strict=True)], *[F.col(f).alias(f"to_{f}") for f in far], "n"))
        grown = saved(grown.select(*name, *far, "n_next", *[(F.col(f"below_{c}") + F.coalesce(f"add_{c}", F.lit(0))).alias(f"below_{c}") for c in ("saved", "leaves")]))
        near = _looked_up(grown.where("up_block > 0"), jumps, far, "n", max(1, jumps.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]))
        near = near.select(*name, *[F.col(f"to_{f}").alias(f) for f in far], "n_next", "below_saved", "below_leaves")
        ends = saved(near.unionByName(grown.where("up_block = 0")))
        step *= 2
    return ends.select(*name, "below_saved", "below_leaves", "n_next")


def _joined_ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pieces of a node's ids, in rising order, from rows sorted by node and id."""
    for batch in batches:
        if not len(batch):
            continue
        keys = batch[list(_NODE)]
        new = (keys != keys.shift()).any(axis=1).to_numpy()
        starts = new.nonzero()[0]
        ids = batch.conv_id.astype(str).to_numpy()
        stops = [*starts[1:], len(batch)]
        out = keys.iloc[starts].copy()
        out["first"] = batch.conv_id.to_numpy()[starts]
        out["ids"] = [",".join(ids[a:b]) for a, b in zip(starts, stops, strict=True)]
        yield out


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of each node's pieces, from rows sorted by node and first id; one running digest is held."""
    key, digest = None, None
    for batch in batches:
        out = []
        for *k, ids in zip(*[batch[c] for c in _NODE], batch.ids, strict=True):
            if k != key:
                if key is not None:
                    out.append((*key, digest.hexdigest()))
                key, digest = k, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        yield pd.DataFrame(out, columns=[*_NODE, "ends_sha256"])
    if key is not None:
        yield pd.DataFrame([(*key, digest.hexdigest())], columns=[*_NODE, "ends_sha256"])


def _end_digests(blocks: DataFrame) -> DataFrame:
    ends = blocks.groupBy("conv_id").agg(F.sum("n_slots").cast("long").alias("depth"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    kinds = "depth long, x long, y long"
    # many conversations may end at one node: parts of its ids are joined first, and only the pieces meet in one task
    pieces = ends.repartitionByRange(*_NODE, "conv_id").sortWithinPartitions(*_NODE, "conv_id").mapInPandas(_joined_ids, f"{kinds}, first long, ids string")
    return pieces.repartition(*_NODE).sortWithinPartitions(*_NODE, "first").mapInPandas(_digests, f"{kinds}, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame, width: int = WIDTH) -> DataFrame:
    """A row for each distinct prefix of conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: (conv_id, position from 1 without gaps, slot from turn_slot); convs:
    the conv_id of every conversation, once, also of those without turns. A
    node's conv_id is its smallest member. n_leaves and saved_tokens are sums
    over the node's subtree, itself included: of childless nodes, and of
    (members - 1) times the bytes of the last turn's text. ends_sha256 is the
    digest of the ids, comma-joined in rising order, of members that end there.
    No conversation, no row; else the root of depth 0 is one.

    ROLLUP over `width` turn columns counts all prefixes of a block at once,
    and a second one sums what they save over subtrees. A longer conversation
    goes on in further blocks under the name of the node where the block
    before ended, a 128-bit hash of its turns. Frequent prefixes are combined
    before the shuffle; children of a hot node take its id from a broadcast of
    at most 1 / HOT_SHARE rows.
    """
    blocks = saved(_blocks(turns, convs, width))
    # the conversation that goes on longest tells which nodes of the block have children in it
    nodes = saved(_names(_rolled(blocks, width, "count(1) as n_convs, min(conv_id) as conv_id, max(n_slots) as longest"), width))
    last_block = nodes.agg(F.max("block")).first()[0] or 0
    saves = F.when(F.col("level") > 0, (F.col("n_convs") - 1) * _slot_bytes(F.col("last"))).otherwise(F.lit(0).cast("long"))
    leaf = (F.col("longest") == F.col("level")).cast("long")
    nodes = nodes.withColumn("saved", saves)
    if last_block:
        roots = nodes.where("block > 0").select((F.col("block") - 1).alias("block"), F.col("px").alias("x"), F.col("py").alias("y"), F.lit(True).alias("goes_on")).distinct()
        full = nodes.where(F.col("level") == width).join(roots, ["block", "x", "y"], "left").withColumn("goes_on", F.coalesce("goes_on", F.lit(False)))
        nodes = saved(nodes.where(F.col("level") < width).withColumn("goes_on", F.lit(False)).unionByName(full).withColumn("leaf", F.when(F.col("goes_on"), 0).otherwise(leaf)))
        below = _below_blocks(nodes, last_block).withColumn("block", F.col("block") - 1)
        full = nodes.where("goes_on").join(below, ["block", "x", "y"], "left")
        full = full.withColumn("saved", F.col("saved") + F.col("below_saved")).withColumn("leaf", F.col("below_leaves"))
        nodes = full.drop("below_saved", "below_leaves").unionByName(nodes.where("not goes_on").withColumn("n_next", F.lit(0).cast("long")))
    else:
        nodes = nodes.withColumn("leaf", leaf).withColumn("n_next", F.lit(0).cast("long"))
    kids = ", ".join(f"count_if(level = {i + 1}) as k{i + 1}" for i in range(width))
    sums = f"min(conv_id) as conv_id, max(n_convs) as n_convs, sum(saved) as saved_tokens, sum(leaf) as n_leaves, sum(n_next) as n_next, {kids}"
    slim = nodes.select("block", "px", "py", *[f"s{i + 1}" for i in range(width)], "level", "conv_id", "n_convs", "saved", "leaf", "n_next")
    tree = _names(_rolled(slim, width, sums), width)
    children = F.when(F.col("level") == width, F.col("n_next")).otherwise(F.get(F.array(*[f"k{i + 1}" for i in range(width)]), F.col("level")))
    tree = tree.withColumn("n_children", children).join(_end_digests(blocks), list(_NODE), "left")
    tree = saved(tree.select(*_NODE, (F.col("depth") - 1).alias("up_depth"), "up_x", "up_y", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256")))
    up = ["up_depth", "up_x", "up_y"]
    parents = tree.where("n_children > 0").select(*[F.col(c).alias(u) for c, u in zip(_NODE, up, strict=True)], F.col("conv_id").alias("parent_conv_id"), "n_children").withColumnRenamed("n_children", "n")
    inner = _looked_up(tree.where("depth > 0"), parents, up, "n", tree.count())
    top = tree.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return inner.select(*out).unionByName(top.select(*out))


def conversation_trie(conversations: DataFrame, group: int = 5, longest: int = 8, width: int = WIDTH) -> DataFrame:
    """The prefix trie of conversations (conv_id, turn, role, text) after with_shared_openings.

    Null roles and texts are empty ones. Rows without conv_id are left out. A
    null turn comes first; turns of one number are ordered by their slot, and a
    repeated row is a turn of its own. Long texts are hashed, never sent.
    Extra columns are ignored; an empty table gives no rows.
    """
    turns, convs = with_shared_openings(conversations, group, longest)
    return prefix_trie(turns, convs, width)
