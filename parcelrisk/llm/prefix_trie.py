"""The trie of conversations by their first turns, with figures of every subtree by an Euler tour.

A node is a sequence of turns that some conversation begins with. The tour enters and leaves each node once; a distributed list ranking
gives every arc its place, and running sums over the places give what lies in a subtree as the difference of two of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelrisk.llm import list_ranking
from parcelrisk.llm.common import Scratch, scan, spread_join

IDS_A_CHUNK = 10_000
PLUS = lambda a, b: a + b
XOR = lambda a, b: a.bitwiseXOR(b)


def turns(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, pos (1, 2, ... by turn, null first, then by the turn's digest), m (digest of role and text), n_chars. Rows without conv_id are left out."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    d = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("m"), F.length(text).cast("long").alias("n_chars"))
    return scratch.write(scan(d, ["conv_id"], ["turn", "m"], {"pos": (F.sum, PLUS, F.lit(1))}, scratch, "sorted").drop("turn"), "turns")


def replayed(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with up to five turns of the first of their hundred: conv_id, depth, m, n_chars; and conv_id, length of each, also without turns.

    Conversation c takes the first h = crc32(c) mod 6 turns of c - c mod 100 (all if it has fewer), then its own turns after its first h.
    """
    sizes = scratch.write(turns.groupBy("conv_id").agg(F.count("*").alias("n")).withColumns({"h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6, "first": F.expr("conv_id - conv_id % 100")}), "sizes")
    firsts = sizes.select(F.col("conv_id").alias("first"), F.col("n").alias("n_first"))
    convs = scratch.write(sizes.join(firsts, "first", "left").select("conv_id", "first", "n", "h", F.least("h", F.coalesce("n_first", F.lit(0))).alias("k")), "convs")
    own = spread_join(turns, convs.select("conv_id", "h", "k"), ["conv_id"]).filter("pos > h").select("conv_id", F.expr("k + pos - h").alias("depth"), "m", "n_chars")
    opening = turns.filter("pos <= 5").select(F.col("conv_id").alias("first"), F.col("pos").alias("depth"), "m", "n_chars")
    taken = convs.filter("k > 0").select("conv_id", "first", "k").join(opening, "first").filter("depth <= k").select("conv_id", "depth", "m", "n_chars")
    return own.union(taken), convs.select("conv_id", F.expr("k + greatest(n - h, 0)").alias("length"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the joined chunks of each node; chunks of a node follow each other, at most one is in memory."""
    node, state = None, None
    schema = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])
    close = lambda: pa.RecordBatch.from_pylist([{"conv_id": node[0], "depth": node[1], "ends_sha256": state.hexdigest()}], schema)
    for b in batches:
        for c, d, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            if (c, d) != node:
                if node is not None:
                    yield close()
                node, state = (c, d), hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.as_buffer())
    if node is not None:
        yield close()


def _ends(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """conv_id, depth, ends_sha256 of nodes at which conversations end: ends (conv_id, depth, member).

    Ids are joined in chunks of a range of ids each, so a chunk is short whatever ends there. A digest over a list is one sequence of
    steps: the chunks of one node are read by one task, as a stream.
    """
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("member")), lambda m: m.cast("string")), ",")
    chunks = ends.groupBy("conv_id", "depth", F.floor(F.col("member") / IDS_A_CHUNK).alias("chunk")).agg(joined.cast("binary").alias("ids"))
    dealt = chunks.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "chunk").select("conv_id", "depth", "ids")
    return dealt.mapInArrow(_digests, "conv_id long, depth long, ends_sha256 string")


def prefix_trie(steps: DataFrame, lengths: DataFrame, scratch: Scratch | None = None, base: int = 50_000) -> DataFrame:
    """One row per distinct sequence of first turns, and the empty one's.

    ``steps`` (conv_id, depth from 1 without gaps, m, n_chars) are the turns of conversations, ``lengths`` (conv_id, length) names each
    conversation once, those without turns too. Returns conv_id (smallest member), depth, parent_conv_id, n_convs (members), n_children,
    n_leaves (nodes without children in the subtree), saved_tokens (sum over the subtree of (members - 1) * n_chars), ends_sha256 of the
    ids that end there. Conversations, copies and children of one node may be any number; no conversations give no rows.
    """
    scratch = scratch or Scratch(steps.sparkSession, "trie")
    hashes = steps.withColumns({"hx": F.xxhash64("depth", "m"), "hy": F.xxhash64("m", "depth", F.lit("y"))})
    keyed = scan(hashes, ["conv_id"], ["depth"], {"x": (F.bit_xor, XOR, "hx"), "y": (F.bit_xor, XOR, "hy")}, scratch, "hashed")
    keyed = scratch.write(keyed.select("conv_id", "depth", "n_chars", "x", "y", XOR(F.col("x"), F.col("hx")).alias("px"), XOR(F.col("y"), F.col("hy")).alias("py")), "keyed")
    root = lengths.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    zero = F.lit(0).cast("long")
    nodes = keyed.groupBy("depth", "x", "y").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("px").alias("px"), F.first("py").alias("py"), F.first("n_chars").alias("n_chars"))
    nodes = scratch.write(nodes.unionByName(root.select(zero.alias("depth"), zero.alias("x"), zero.alias("y"), "conv_id", "n_convs", zero.alias("px"), zero.alias("py"), zero.alias("n_chars"))), "nodes")
    # conversations by the node they end at
    last = keyed.join(lengths.filter("length > 0").select("conv_id", F.col("length").alias("depth")), ["conv_id", "depth"]).select("depth", "x", "y", F.col("conv_id").alias("member"))
    last = scratch.write(last.union(lengths.filter("length = 0").select(zero, zero, zero, "conv_id")), "last")
    ids = nodes.select("depth", "x", "y", "conv_id")
    ends = _ends(nodes, spread_join(last, ids, ["depth", "x", "y"]).select("conv_id", "depth", "member"))
    below = scratch.write(nodes.filter("depth > 0").select("conv_id", "depth", (F.col("depth") - 1).alias("up"), "px", "py"), "below")
    parents = ids.select(F.col("depth").alias("up"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias("parent_conv_id"))
    child = spread_join(below, parents, ["up", "px", "py"]).select("conv_id", "depth", "parent_conv_id")
    child = scratch.write(scan(child, ["parent_conv_id", "depth"], ["conv_id"], {"r": (F.sum, PLUS, F.lit(1))}, scratch, "siblings"), "children")
    families = child.groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"), F.min("conv_id").alias("eldest"))
    nodes = nodes.select("conv_id", "depth", "n_convs", "n_chars").join(families, ["conv_id", "depth"], "left").join(child.select("conv_id", "depth", "parent_conv_id", "r"), ["conv_id", "depth"], "left")
    after = child.select("parent_conv_id", "depth", (F.col("r") - 1).alias("r"), F.col("conv_id").alias("sibling"))
    nodes = scratch.write(nodes.join(after, ["parent_conv_id", "depth", "r"], "left"), "linked")
    tour = scratch.write(nodes.select(F.explode(F.array(*_arcs())).alias("a"), "conv_id", "depth", "n_children", "n_convs", "n_chars").select("a.*", "conv_id", "depth", "n_children", "n_convs", "n_chars"), "tour")
    places = list_ranking.rank(tour.select("id", "next"), scratch, base)
    weighed = tour.select("id", "conv_id", "depth", "enters", F.when(F.col("enters") & F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("leaf"), F.when(F.col("enters"), (F.col("n_convs") - 1) * F.col("n_chars")).otherwise(0).alias("saving"))
    summed = scan(weighed.join(places, "id").drop("id"), [], ["position"], {"leaves": (F.sum, PLUS, "leaf"), "saved": (F.sum, PLUS, "saving")}, scratch, "places")
    inside = lambda total, own: F.sum(F.when(F.col("enters"), F.col(own) - F.col(total)).otherwise(F.col(total)))
    subtrees = summed.groupBy("conv_id", "depth").agg(inside("leaves", "leaf").alias("n_leaves"), inside("saved", "saving").alias("saved_tokens"))
    out = nodes.join(subtrees, ["conv_id", "depth"]).join(ends, ["conv_id", "depth"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


def _arcs() -> list[Column]:
    """The arcs into and out of a node, each with the arc that follows it in the tour."""
    name = lambda side, conv, depth: F.concat_ws(" ", F.lit(side), F.col(conv), depth)
    d = F.col("depth")
    enter, leave = name("+", "conv_id", d), name("-", "conv_id", d)
    down = F.when(F.col("eldest").isNotNull(), name("+", "eldest", d + 1)).otherwise(leave)
    on = F.when(F.col("sibling").isNotNull(), name("+", "sibling", d)).when(F.col("parent_conv_id").isNotNull(), name("-", "parent_conv_id", d - 1))
    return [F.struct(enter.alias("id"), down.alias("next"), F.lit(True).alias("enters")), F.struct(leave.alias("id"), on.alias("next"), F.lit(False).alias("enters"))]


def conversation_trie(conversations: DataFrame, base: int = 50_000) -> DataFrame:
    """``prefix_trie`` of the conversations as ``replayed`` rebuilds them from (conv_id, turn, role, text).

    Null roles and texts count as empty, null turns come first, turns of one number are ordered by their digest, repeated rows are turns
    of their own, and rows without conv_id belong to no conversation. Further columns do not matter.
    """
    scratch = Scratch(conversations.sparkSession, "trie")
    steps, lengths = replayed(turns(conversations, scratch), scratch)
    return prefix_trie(scratch.write(steps, "steps"), scratch.write(lengths, "lengths"), scratch, base)
