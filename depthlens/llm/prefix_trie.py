"""Conversation prefix trie from padded matrices of turn ids.

A conversation is a row of turn ids.  Rows are sorted, so every trie node - a distinct sequence of first turns - is a run
of neighbouring rows.  In a block of rows the ids form a matrix padded with zeros: ``numpy.lexsort`` orders it, a change
mask against the row above, OR-accumulated over the columns, marks in which rows the nodes of each depth start, and
``reduceat`` over those starts aggregates all nodes of a depth at once.

Spark spreads the rows over range shards (sampled on the whole row and the conversation, so a conversation that thousands
repeat is split).  A shard is read as a stream of blocks; nodes that touch a block's first or last row may go on in the
neighbour.  Those boundary nodes - at most two per depth and block - are recombined by a grouped sum, and what their subtrees add up to
by pointer doubling over the boundary nodes alone: log2(depth) rounds of one join and one sum.  All other nodes are final
when the block has been read.

Rows are cut into segments of ``WIDTH`` turns, so neither a matrix nor a task holds a whole long conversation.  A segment starts
at the id of the node that its earlier turns lead to, and nodes on the way to a later segment count as boundary nodes.

Turns are 128-bit hashes of (depth, role, text), and a node's id is the XOR of its turns' hashes: two of N nodes meet by
chance with a probability of about N**2 / 2**129.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from depthlens.operators.ordered import RN, order_rows
from depthlens.session import write_table

#: Turns of one segment, and cells of one block's matrix.
WIDTH, CELLS = 64, 1 << 19
#: Conversations are numbered in families of this size, which share the head of their first member.
FAMILY, HEADS = 5, 9

EMPTY_SHA = hashlib.sha256(b"").hexdigest()
_NODE = (
    "depth long, id1 long, id2 long, up1 long, up2 long, conv_id long, n_convs long, size long, n_children long, n_leaves long, "
    "saved_tokens long, ends_sha256 string, ends binary, ends_from long, open boolean, up_conv long, up_open boolean"
)
_INTS = [f.split()[0] for f in _NODE.split(", ")][:11]


def rebuilt_turns(conversations: DataFrame, heads: int = HEADS, family: int = FAMILY) -> DataFrame:
    """conv_id, depth (from 1), h1, h2, size, n_turns of every rebuilt turn; depth 0 stands for the conversation itself.

    Conversation c gets the first h = crc32(c) % ``heads`` turns of c - c % ``family`` and then its own after its first h.  Turns are
    ordered by ``turn`` (null first), ties by role and by the hashes of role and text; null roles and texts are empty.
    Rows with a null conv_id belong to no conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.xxhash64(role, text).alias("h1"),
        F.xxhash64(F.lit(1), text, role).alias("h2"), F.octet_length(text).cast("long").alias("size"),
    )
    own = order_rows(turns, ["conv_id"], ["turn", "role", "h1", "h2", "size"]).df.drop("turn", "role").withColumn("at", F.col(RN) + 1).drop(RN)
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    first = own.filter((F.col("conv_id") % family == 0) & (F.col("at") < heads)).groupBy(F.col("conv_id").alias("base")).agg(
        F.array_sort(F.collect_list(F.struct("at", "h1", "h2", "size"))).alias("turns")
    )  # fewer than ``heads`` turns each
    convs = own.groupBy("conv_id").agg(F.count("*").alias("own")).withColumns({"h": head, "base": F.col("conv_id") - F.col("conv_id") % family})
    convs = convs.join(first, "base", "left").withColumn("lent", F.expr("slice(coalesce(turns, array()), 1, cast(h as int))"))
    m = F.size("lent").cast("long")
    convs = convs.select("conv_id", "h", "lent", m.alias("m"), (m + F.greatest(F.lit(0), F.col("own") - F.col("h"))).alias("n_turns"))
    marks = convs.select("conv_id", "n_turns", F.explode(F.expr("array_prepend(lent, named_struct('at', 0L, 'h1', 0L, 'h2', 0L, 'size', 0L))")).alias("t"))
    marks = marks.select("conv_id", "n_turns", F.col("t.at").alias("depth"), "t.h1", "t.h2", "t.size")
    rest = own.join(convs.select("conv_id", "h", "m", "n_turns"), "conv_id").filter(F.col("at") > F.col("h"))
    rest = rest.select("conv_id", "n_turns", (F.col("at") - F.col("h") + F.col("m")).alias("depth"), "h1", "h2", "size")
    both = marks.unionByName(rest)
    return both.withColumns({"h1": F.xxhash64("h1", "h2", "depth"), "h2": F.xxhash64("depth", "h2", "h1")})


def segments(turns: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per conversation and segment: conv_id, seg, k1, k2 (node where it starts), path, sizes, more (goes on later)."""
    seg = F.when(F.col("depth") == 0, 0).otherwise(F.floor((F.col("depth") - 1) / width)).cast("long")
    packed = turns.withColumn("seg", seg).groupBy("conv_id", "seg").agg(
        F.array_sort(F.collect_list(F.when(F.col("depth") > 0, F.struct("depth", "h1", "h2", "size")))).alias("t"),
        F.bit_xor(F.when(F.col("depth") > 0, F.col("h1")).otherwise(F.lit(0))).alias("x1"),
        F.bit_xor(F.when(F.col("depth") > 0, F.col("h2")).otherwise(F.lit(0))).alias("x2"),
        F.max("n_turns").alias("n_turns"),
    )
    packed = packed.select(
        "conv_id", "seg", "x1", "x2", F.flatten(F.transform("t", lambda x: F.array(x.h1, x.h2))).alias("path"),
        F.transform("t", lambda x: x["size"]).alias("sizes"), (F.col("n_turns") > (F.col("seg") + 1) * width).alias("more"), "n_turns",
    )
    packed = write_table(packed, "segments")
    before = Window.partitionBy("conv_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    starts = packed.filter(F.col("n_turns") > width).select(
        "conv_id", "seg", *[F.coalesce(F.bit_xor(x).over(before), F.lit(0)).alias(k) for x, k in (("x1", "k1"), ("x2", "k2"))]
    ).filter("seg > 0")
    long, short = packed.filter("seg > 0").join(starts, ["conv_id", "seg"]), packed.filter("seg = 0")
    columns = ["conv_id", "seg", "k1", "k2", "path", "sizes", "more"]
    return short.withColumns({"k1": F.lit(0).cast("long"), "k2": F.lit(0).cast("long")}).select(columns).unionByName(long.select(columns))


def _dense(*columns: np.ndarray) -> np.ndarray:
    """Numbers from 1 of the distinct tuples, in their order."""
    order = np.lexsort(columns[::-1])
    change = np.ones(len(order), bool)
    change[1:] = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in columns])
    out = np.empty(len(order), np.int32)
    out[order] = np.cumsum(change)
    return out


def block_nodes(conv: np.ndarray, seg: np.ndarray, k1: np.ndarray, k2: np.ndarray, more: np.ndarray, paths: np.ndarray, sizes: np.ndarray, n: np.ndarray, width: int):
    """Nodes of one block of sorted rows, as columns; ``n`` has the rows' numbers of turns, ``paths`` two values a turn."""
    rows, deep = len(conv), int(n.max(initial=0))
    valid = np.arange(deep) < n[:, None]
    h1, h2, size = (np.zeros((rows, deep), np.int64) for _ in range(3))
    h1[valid], h2[valid], size[valid] = paths[::2], paths[1::2], sizes
    turn = np.zeros((rows, deep), np.int32)
    turn[valid] = _dense(paths[::2], paths[1::2]) if len(sizes) else 0
    start = _dense(seg, k1, k2)
    order = np.lexsort((conv, *turn.T[::-1], start))
    conv, seg, k1, k2, more, n, start, turn, h1, h2, size, valid = (x[order] for x in (conv, seg, k1, k2, more, n, start, turn, h1, h2, size, valid))
    first = np.ones((rows, deep + 1), bool)  # a node starts here
    first[1:, 0] = start[1:] != start[:-1]
    first[1:, 1:] = turn[1:] != turn[:-1]
    first = np.logical_or.accumulate(first, axis=1)
    id1 = np.bitwise_xor.accumulate(np.hstack([k1[:, None], h1]), axis=1)
    id2 = np.bitwise_xor.accumulate(np.hstack([k2[:, None], h2]), axis=1)
    leaves, saved, child = (np.zeros(rows, np.int64) for _ in range(3))  # of final nodes below, at the rows where those start
    found = []
    for j in range(deep, -1, -1):
        at = np.flatnonzero(first[:, j])
        end = np.append(at[1:], rows)
        real = valid[at, j - 1] if j else np.ones(len(at), bool)
        total = lambda x: np.add.reduceat(x, at)
        is_open = (at == 0) | (end == rows) | np.maximum.reduceat(more, at) | ((j == 0) & (seg[at] > 0))
        counted = np.zeros(len(at), bool) if not j else real  # depth 0 of a later segment is counted where it ends the one before
        counted = counted | (seg[at] == 0)
        ending = (n == j) & ~more
        up = {"up1": id1[at, max(j - 1, 0)], "up2": id2[at, max(j - 1, 0)]}
        node = {
            "depth": seg[at] * width + j, "id1": id1[at, j], "id2": id2[at, j], **up, "conv_id": np.minimum.reduceat(conv, at),
            "n_convs": np.where(counted, end - at, 0), "size": size[at, j - 1] if j else np.zeros(len(at), np.int64), "n_children": total(child),
            "n_leaves": total(leaves), "saved_tokens": total(saved),
        }
        node["real"], node["open"], node["at"], node["top"] = real, is_open, at, np.full(len(at), j == 0)
        final = real & ~is_open
        node["n_leaves"] += final & (node["n_children"] == 0)
        node["saved_tokens"] += np.where(final, (node["n_convs"] - 1) * node["size"], 0)
        last = np.flatnonzero(ending)  # of a node's rows these have the same path: conversations in ascending order
        node["ends"] = [conv[last[a:b]] for a, b in zip(*(np.searchsorted(last, x).tolist() for x in (at, end)))]
        leaves, saved, child = (np.zeros(rows, np.int64) for _ in range(3))
        leaves[at], saved[at], child[at] = (np.where(final, x, 0) for x in (node["n_leaves"], node["saved_tokens"], final))
        found.append(node)
    # an open node's children and all above it are open or known here; a final node below an open one looks its parent up later
    for below, above in itertools.pairwise(found):
        owner = np.searchsorted(above["at"], below["at"], "right") - 1
        below["up_conv"], below["up_open"] = above["conv_id"][owner], above["open"][owner]
    found[-1]["up_conv"], found[-1]["up_open"] = found[-1]["conv_id"], np.ones(len(found[-1]["at"]), bool)
    out = {c: np.concatenate([f[c][f["real"]] for f in found]) for c in [*_INTS, "open", "top", "up_conv", "up_open"]}
    out["ends"] = [e for f in found for e, r in zip(f["ends"], f["real"]) if r]
    return out


def _digest(ids: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest() if len(ids) else EMPTY_SHA


def shard_nodes(rows: DataFrame, width: int = WIDTH, cells: int = CELLS) -> DataFrame:
    """Nodes of each block of ``segments``: final ones whole, open ones (boundary nodes) as far as the block has them."""
    key = ["seg", "k1", "k2", "path", "conv_id"]

    def blocks(batches):
        """Rows of a shard in pieces whose padded matrix has at most ``cells`` cells, or of one row."""
        for b in batches:
            n = np.diff(np.asarray(b.column("sizes").offsets))
            lo = 0
            while lo < len(n):
                widest = np.maximum.accumulate(n[lo:] + 1)
                fit = int(np.searchsorted(widest * np.arange(1, len(widest) + 1), cells, "right"))
                hi = lo + max(1, fit)
                yield b.slice(lo, hi - lo)
                lo = hi

    def run(batches):
        for b in blocks(batches):
            ints = [b.column(c).to_numpy(zero_copy_only=False) for c in ("conv_id", "seg", "k1", "k2", "more")]
            paths, sizes = b.column("path"), b.column("sizes")
            out = block_nodes(*ints, paths.flatten().to_numpy(), sizes.flatten().to_numpy(), np.diff(np.asarray(sizes.offsets)), width)
            is_open, top = out["open"], out["top"]
            later = top & (out["depth"] > 0)  # counted in the segment before: only what lies below it is added here
            root = top & ~later
            columns = [pa.array(out[c], mask=later if c in ("conv_id", "size") else top if c in ("up1", "up2") else None) for c in _INTS]
            ends = [None if o else _digest(e) for o, e in zip(is_open.tolist(), out["ends"])]
            chunks = [e.tobytes() if o and len(e) else None for o, e in zip(is_open.tolist(), out["ends"])]
            starts = [int(e[0]) if len(e) else None for e in out["ends"]]
            columns += [pa.array(ends, pa.string()), pa.array(chunks, pa.binary()), pa.array(starts, pa.int64()), pa.array(is_open), pa.array(out["up_conv"], mask=root | later), pa.array(out["up_open"])]
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in _NODE.split(", ")])

    return rows.repartitionByRange(*key).sortWithinPartitions(*key).mapInArrow(run, _NODE)


def _open_nodes(parts: DataFrame) -> DataFrame:
    """Open nodes recombined: depth, id, parent's id, conv_id, n_convs, n_children, n_leaves, saved_tokens."""
    ident, up = ["id1", "id2"], ["up1", "up2"]
    nodes = parts.filter("open").groupBy("depth", *ident).agg(
        *[F.max(c).alias(c) for c in (*up, "size")], F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
    )
    nodes = write_table(nodes, "open_nodes")
    below = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), *[F.col(u).alias(i) for u, i in zip(up, ident)]).agg(F.count("*").alias("more"))
    nodes = nodes.join(below, ["depth", *ident], "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0))).drop("more")
    nodes = nodes.withColumns({
        "n_leaves": F.col("n_leaves") + (F.col("n_children") == 0).cast("long"),
        "saved_tokens": F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("size"),
    })
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    # pointer doubling: after round r a node has the sums of all nodes up to 2**r - 1 levels below it, and points 2**r levels up
    sums = write_table(nodes.select("depth", *ident, F.col("up1").alias("to1"), F.col("up2").alias("to2"), "n_leaves", "saved_tokens"), "subtrees")
    reach = 1
    while reach <= deepest:
        target = [(F.col("depth") - reach).alias("depth"), F.col("to1").alias("id1"), F.col("to2").alias("id2")]
        added = sums.filter(F.col("depth") >= reach).groupBy(*target).agg(F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
        higher = sums.select(F.col("depth").alias("d"), F.col("id1").alias("i1"), F.col("id2").alias("i2"), F.col("to1").alias("j1"), F.col("to2").alias("j2"))
        hop = sums.join(higher, (F.col("d") == F.col("depth") - reach) & (F.col("i1") == F.col("to1")) & (F.col("i2") == F.col("to2")), "left")
        hop = hop.select("depth", *ident, F.col("j1").alias("to1"), F.col("j2").alias("to2"), "n_leaves", "saved_tokens")
        sums = write_table(
            hop.join(added, ["depth", *ident], "left").select(
                "depth", *ident, "to1", "to2", (F.col("n_leaves") + F.coalesce("l", F.lit(0))).alias("n_leaves"),
                (F.col("saved_tokens") + F.coalesce("s", F.lit(0))).alias("saved_tokens"),
            ),
            "subtrees",
        )
        reach *= 2
    return nodes.drop("n_leaves", "saved_tokens").join(sums.select("depth", *ident, "n_leaves", "saved_tokens"), ["depth", *ident])


def _end_digests(parts: DataFrame) -> DataFrame:
    """Digests of the ids that end at open nodes, fed chunk by chunk in ascending order."""
    chunks = parts.filter("ends IS NOT NULL").select("depth", "id1", "id2", "ends", "ends_from")

    def run(batches):
        at, sha = None, None
        for b in batches:
            for depth, id1, id2, ends in zip(*(b.column(c).to_pylist() for c in ("depth", "id1", "id2", "ends"))):
                text = ",".join(map(str, np.frombuffer(ends, np.int64).tolist())).encode()
                if at == (depth, id1, id2):
                    sha.update(b"," + text)
                    continue
                if at is not None:
                    yield made(at, sha)
                at, sha = (depth, id1, id2), hashlib.sha256(text)
        if at is not None:
            yield made(at, sha)

    def made(at, sha):
        return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in at), pa.array([sha.hexdigest()])], names=["depth", "id1", "id2", "sha"])

    return chunks.repartition("depth", "id1", "id2").sortWithinPartitions("depth", "id1", "id2", "ends_from").mapInArrow(run, "depth long, id1 long, id2 long, sha string")


def prefix_trie(turns: DataFrame, width: int = WIDTH, cells: int = CELLS) -> DataFrame:
    """Per trie node of ``turns`` (see ``rebuilt_turns``): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A conversation without turns is a member of the root alone.  No conversations give no nodes.
    """
    parts = write_table(shard_nodes(segments(turns, width), width, cells), "nodes")
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    opened = write_table(_open_nodes(parts), "opened")
    done = parts.filter("NOT open")
    inner = done.filter("NOT up_open").withColumn("parent_conv_id", F.col("up_conv"))
    parents = opened.select((F.col("depth") + 1).alias("depth"), F.col("id1").alias("up1"), F.col("id2").alias("up2"), F.col("conv_id").alias("parent_conv_id"))
    edge = done.filter("up_open").join(parents, ["depth", "up1", "up2"])
    opened = opened.join(parents, ["depth", "up1", "up2"], "left").join(_end_digests(parts), ["depth", "id1", "id2"], "left")
    opened = opened.withColumn("ends_sha256", F.coalesce("sha", F.lit(EMPTY_SHA)))
    return inner.select(out).unionByName(edge.select(out)).unionByName(opened.select(out))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The prefix trie of the rebuilt conversations; see ``rebuilt_turns`` and ``prefix_trie``."""
    return prefix_trie(rebuilt_turns(conversations))


CONVERSATION_TRIE_SQL = """WITH turns AS (
  SELECT conv_id, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS x, turn FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, list(x ORDER BY turn NULLS FIRST, x) AS own FROM turns GROUP BY conv_id),
sums AS (
  SELECT *, conv_id - conv_id % 5 AS base, xor(4294967295, list_reduce(
    list_concat([4294967295], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: [CAST(ascii(s) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, 3988292384 * (c & 1)) END)) % 9 AS h
  FROM convs),
rebuilt AS (
  SELECT s.conv_id, list_concat(list_slice(coalesce(b.own, []), 1, h), list_slice(s.own, h + 1, len(s.own))) AS path
  FROM sums s LEFT JOIN convs b ON b.conv_id = s.base),
members AS (SELECT conv_id, len(path) AS n, path, unnest(range(0, len(path) + 1)) AS depth FROM rebuilt),
nodes AS (
  SELECT list_slice(path, 1, depth) AS node, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
  FROM members GROUP BY ALL),
children AS (SELECT list_slice(node, 1, depth - 1) AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
own AS (
  SELECT nodes.*, coalesce(n_children, 0) AS n_children, CASE WHEN depth > 0 THEN (n_convs - 1) * strlen(node[depth].t) ELSE 0 END AS saved
  FROM nodes LEFT JOIN children USING (node)),
below AS (SELECT list_slice(node, 1, k) AS node, sum((n_children = 0)::INT) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT node, n_children, saved, unnest(range(0, depth + 1)) AS k FROM own) GROUP BY ALL)
SELECT own.conv_id, own.depth, up.conv_id AS parent_conv_id, own.n_convs, own.n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
  CAST(saved_tokens AS BIGINT) AS saved_tokens, own.ends_sha256
FROM own JOIN below USING (node) LEFT JOIN nodes up ON own.depth > 0 AND up.node = list_slice(own.node, 1, own.depth - 1)"""
