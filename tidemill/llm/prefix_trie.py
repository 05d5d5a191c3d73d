"""The prefix trie of conversations, from the LCP array of their sorted turns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ordering import in_order
from .common import materialise, pick, squeeze, table, unsqueeze

#: Turns of a chunk by which long conversations are compared first, conversations of a block.
CHUNK, BLOCK = 32, 4096
FAR = np.iinfo(np.int64).max
NONE = hashlib.sha256(b"").hexdigest()
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, chars): the turns of each conversation from 0, a null turn first, ties by digest.

    A turn's digest is the MD5 of its role and text, null ones as empty, with the role's length
    in front; texts go no further than here. All turns are numbered in one order of
    (conversation, turn), so a conversation may have any share of the rows.
    """
    held = pick(conversations, conv_id="conv_id", turn="turn", role="role", text="text").where("conv_id is not null")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)))
    turns = held.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.char_length(text).cast("long").alias("chars"))
    return in_order(turns, "turn", "digest", name="pos", by=("conv_id",)).select("conv_id", "pos", "digest", "chars")


def with_shared_heads(turns: DataFrame, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on the head of another, as (turns, lengths).

    Conversation c takes the first crc32(c) % ``most`` turns of conversation c - c % ``every`` and
    its own turns behind as many; at most ``every`` conversations share one head.
    """
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("size"))
    heads = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most))
    convs = sizes.withColumn("head", heads).withColumn("base", F.col("conv_id") - F.col("conv_id") % every)
    convs = convs.join(sizes.select(F.col("conv_id").alias("base"), F.col("size").alias("base_size")), "base", "left")
    convs = convs.withColumn("taken", F.least("head", F.coalesce("base_size", F.lit(0))))
    lengths = convs.select("conv_id", (F.col("taken") + F.greatest(F.col("size") - F.col("head"), F.lit(0))).alias("length"))
    first = turns.where((F.col("pos") < most - 1) & (F.col("conv_id") % every == 0)).withColumnRenamed("conv_id", "base")
    shared = convs.where("taken > 0").select("conv_id", "base", "taken").join(first, "base").where("pos < taken").select("conv_id", "pos", "digest", "chars")
    own = turns.join(convs.select("conv_id", "head", "taken"), "conv_id").where("pos >= head")
    own = own.select("conv_id", (F.col("pos") - F.col("head") + F.col("taken")).alias("pos"), "digest", "chars")
    return shared.unionByName(own), lengths


def told_apart(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """``lengths`` with ``kept``: turns after which a conversation is like no other, rounded up to chunks.

    Conversations longer than a chunk are compared by two 64-bit sums over their first 1, 2, ...
    chunks, so that the tail of a very long one needs no sorting.
    """
    long = lengths.where(F.col("length") > CHUNK).select("conv_id")
    chunks = turns.join(long, "conv_id", "left_semi").groupBy("conv_id", F.floor(F.col("pos") / CHUNK).alias("chunk"))
    chunks = chunks.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("pos", "digest")).alias("a"), F.bit_xor(F.xxhash64("digest", "pos")).alias("b")).where(F.col("n") == CHUNK)
    so_far = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    heads = chunks.select("conv_id", "chunk", F.bit_xor("a").over(so_far).alias("a"), F.bit_xor("b").over(so_far).alias("b"))
    repeated = heads.groupBy("chunk", "a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    shared = heads.join(repeated, ["chunk", "a", "b"]).groupBy("conv_id").agg((F.max("chunk") + 1).alias("shared"))
    kept = F.least(F.col("length"), (F.coalesce("shared", F.lit(0)) + 1) * CHUNK)
    return lengths.join(shared, "conv_id", "left").select("conv_id", "length", kept.alias("kept"))


# A block is a run of BLOCK sorted conversations. Its steps are (value, rows, smallest id, heads'
# characters, leaves, rows that begin a child): the places where the minimum of the LCPs so far
# falls, each with what stands up to the next. Seen from a block's start, a node of depth d reaches
# over all steps of value d or more, whatever blocks they come from.


def forward_steps(lcp: np.ndarray, conv: np.ndarray, heads: np.ndarray, leaves: np.ndarray, child: np.ndarray) -> np.ndarray:
    least = np.minimum.accumulate(lcp)
    at = np.flatnonzero(np.r_[True, least[1:] < least[:-1]])
    sums = [np.add.reduceat(v, at) for v in (np.ones_like(lcp), heads, leaves, child & (lcp == least))]
    return np.stack([least[at], sums[0], np.minimum.reduceat(conv, at), *sums[1:]], axis=1)


def joined_steps(steps: np.ndarray, beyond: np.ndarray) -> np.ndarray:
    """The steps of a block and of all blocks behind it."""
    inside = beyond[:, 0] >= steps[-1, 0]
    if inside.any():
        last, more = steps[-1].copy(), beyond[inside]
        last[1], last[2] = last[1] + more[:, 1].sum(), min(last[2], more[:, 2].min())
        last[3:5] += more[:, 3:5].sum(axis=0)
        last[5] += more[more[:, 0] == last[0], 5].sum()
        steps = np.vstack([steps[:-1], last])
    return np.vstack([steps, beyond[~inside]])


def backward_steps(lcp: np.ndarray, conv: np.ndarray) -> np.ndarray:
    """(value, smallest id) seen from behind a block: a node of depth d reaches back over all steps of value d or more."""
    least = np.r_[np.minimum.accumulate(lcp[:0:-1])[::-1], FAR][::-1]
    at = np.flatnonzero(np.r_[True, least[1:] < least[:-1]])
    return np.stack([least[at], np.minimum.reduceat(conv[::-1], at)], axis=1)


def joined_back(steps: np.ndarray, before: np.ndarray, lowest: int) -> np.ndarray:
    both = np.vstack([steps, np.stack([np.minimum(before[:, 0], lowest), before[:, 1]], axis=1)])
    at = np.flatnonzero(np.r_[True, both[1:, 0] < both[:-1, 0]])
    return np.stack([both[at, 0], np.minimum.reduceat(both[:, 1], at)], axis=1)


PACKED = "block long, rows binary, before binary, steps binary, back binary, lowest long, run long, carried long, goes_on long"
FIELDS = [c.split() for c in PACKED.split(", ")]
KINDS = {"long": pa.int64(), "binary": pa.binary()}


def _packed(key: tuple, rows: pa.Table, size: int) -> pa.Table:
    """The LCP array of a block and its summary, from its rows and one neighbour on each side.

    Of each row it keeps id, length, turns sorted by, LCP with the row before, characters of that
    common head, whether a leaf ends with it and whether it equals the row before.
    """
    block = key[0].as_py()
    rows = rows.sort_by("at").combine_chunks()
    at, conv, length, kept = (rows.column(c).to_numpy().astype(np.int64) for c in ("at", "conv_id", "length", "kept"))
    lists = rows.column("turns").combine_chunks()
    flat, ends = lists.flatten(), np.r_[0, np.cumsum(kept)]
    digests = np.frombuffer(b"".join(flat.field("digest").to_pylist()), np.uint64).reshape(-1, 2)
    chars = flat.field("chars").to_numpy(zero_copy_only=False).astype(np.int64)
    lcp = np.full(len(at), -1, np.int64)
    for i in range(1, len(at)):
        n = min(kept[i - 1], kept[i])
        differ = (digests[ends[i - 1] : ends[i - 1] + n] != digests[ends[i] : ends[i] + n]).any(axis=1)
        lcp[i] = differ.argmax() if differ.any() else n
    same = (lcp == length) & (np.r_[-1, length[:-1]] == length)
    own = np.flatnonzero(at // size == block)
    if not len(own):  # the last block was full, and its last row came alone
        return pa.table([pa.array([], KINDS[t]) for _, t in FIELDS], [c for c, _ in FIELDS])
    first, stop = own[0], own[-1] + 1
    follow = np.r_[lcp[1:], -1]
    so_far = np.r_[0, np.cumsum(chars)]
    heads = so_far[ends[:-1] + np.maximum(lcp, 0)] - so_far[ends[:-1]]
    before = [so_far[ends[i] + np.maximum(np.arange(lcp[i], kept[i]), 0)] - so_far[ends[i]] for i in own]
    leaves = (follow < length).astype(np.int64)
    held = np.stack([conv, length, kept, lcp, heads, leaves, same.astype(np.int64)])[:, first:stop]
    begins = np.flatnonzero(held[6] == 0)
    steps = forward_steps(held[3], held[0], held[4], held[5], (held[1] > held[3]).astype(np.int64))
    back = backward_steps(held[3], held[0])
    goes_on = int(stop < len(at) and same[stop])
    run = int(at[first] + begins[-1]) if len(begins) else -1
    values = [block, squeeze(held.ravel()), squeeze(np.concatenate(before)), squeeze(steps.ravel()), squeeze(back.ravel()), int(held[3].min()), run, int(held[6][0]), goes_on]
    return pa.table([pa.array([v], KINDS[t]) for v, (_, t) in zip(values, FIELDS)], [c for c, _ in FIELDS])


def _around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What stands behind and before each block, by one pass over the blocks' summaries in each direction."""
    held = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: r["block"])
    behind, ahead, carry = np.zeros((0, 6), np.int64), np.zeros((0, 2), np.int64), -1
    right: list[bytes] = []
    for r in reversed(held):
        right.append(squeeze(behind.ravel()))
        behind = joined_steps(unsqueeze(r["steps"], np.int64).reshape(-1, 6), behind)
    for r, after in zip(held, reversed(right)):
        yield pa.RecordBatch.from_arrays([pa.array([r["block"]]), pa.array([after], pa.binary()), pa.array([squeeze(ahead.ravel())], pa.binary()), pa.array([carry])], ["of_block", "right", "left", "carry"])
        ahead = joined_back(unsqueeze(r["back"], np.int64).reshape(-1, 2), ahead, r["lowest"])
        carry = r["run"] if r["run"] >= 0 else carry


def intervals(lcp: np.ndarray, length: np.ndarray, kept: np.ndarray, conv: np.ndarray) -> tuple[np.ndarray, ...]:
    """Nodes of a block by nearest smaller values: (end, smallest id, children begun later, parent) of each.

    Nodes stand by row and rising depth, row i beginning those of depth lcp[i] + 1 to kept[i]; in
    front are those of depth 0 to lcp[0], begun in earlier blocks. Entries of the stack are runs of
    depths that one row began, as in a Cartesian tree whose equal values are merged; a smaller LCP
    closes runs or cuts them. The end is the last row of a node, or len(lcp) if it is still open.
    """
    entering = int(lcp[0]) + 1
    places = entering + np.r_[0, np.cumsum(kept - lcp)]
    total = int(places[-1])
    end, least, begun, parent = np.full(total, len(lcp), np.int64), np.full(total, FAR, np.int64), np.zeros(total, np.int64), np.arange(-1, total - 1)
    stack = [[-1, entering - 1, FAR, 0]] if entering else []  # depths above the first up to the second, smallest id, place of the first node
    for i, (v, n, t, c) in enumerate(zip(lcp.tolist(), length.tolist(), kept.tolist(), conv.tolist())):
        small = FAR
        while stack and stack[-1][1] > v:
            top = stack[-1]
            top[2] = small = min(top[2], small)
            cut = max(top[0], v)
            closed = slice(top[3] + cut - top[0], top[3] + top[1] - top[0])
            end[closed], least[closed] = i - 1, small
            if top[0] >= v:
                stack.pop()
            else:
                top[1] = v
        place = int(places[i])
        if stack:
            top = stack[-1]
            over = top[3] + v - top[0] - 1
            top[2] = min(top[2], small)
            if n > v:
                begun[over] += 1
            if t > v:
                parent[place] = over
        if t > v:
            stack.append([v, t, c, place])
        else:
            top[2] = min(top[2], c)
    small = FAR
    for low, high, own, place in reversed(stack):
        small = min(small, own)
        least[place : place + high - low] = small
    return end, least, begun, parent


def _nodes(key: tuple, packed: pa.Table, around: pa.Table, size: int) -> pa.Table:
    """The nodes that a block's rows begin, finished with what the blocks around it add."""
    block, one, other = key[0].as_py(), packed.to_pylist()[0], around.to_pylist()[0]
    conv, length, kept, lcp, heads, leaves, same = unsqueeze(one["rows"], np.int64).reshape(7, -1)
    right, left = unsqueeze(other["right"], np.int64).reshape(-1, 6), unsqueeze(other["left"], np.int64).reshape(-1, 2)
    end, least, begun, parent = intervals(lcp, length, kept, conv)
    entering, rows = int(lcp[0]) + 1, len(lcp)
    row = np.repeat(np.arange(rows), kept - lcp)
    depth = np.arange(len(end)) - np.r_[np.zeros(entering, np.int64), entering + (np.r_[0, np.cumsum(kept - lcp)[:-1]] - lcp - 1)[row]]
    # Steps behind the block that an open node of each depth reaches over, and back to its first row.
    reach = np.where(end == rows, np.searchsorted(-right[:, 0], -depth, side="right"), 0)
    least = np.minimum(least, np.r_[FAR, np.minimum.accumulate(right[:, 2])][reach])
    if entering:
        back = np.searchsorted(-left[:, 0], -depth[:entering], side="right")
        least[:entering] = np.minimum(least[:entering], np.minimum.accumulate(left[:, 1])[back - 1])
    own = slice(entering, None)
    end, reach, depth, begun, parent, mine = end[own], reach[own], depth[own], begun[own], parent[own], least[own]
    summed = np.vstack([np.zeros((1, 6), np.int64), np.cumsum(right, axis=0)])[reach]
    stop = np.minimum(end, rows - 1) + 1
    n = stop - row + summed[:, 1]
    of_heads, of_leaves = np.r_[0, np.cumsum(heads)], np.r_[0, np.cumsum(leaves)]
    saved = of_heads[stop] - of_heads[row + 1] + summed[:, 3] - (n - 1) * unsqueeze(one["before"], np.int64)
    ends_here = np.r_[-2, right[:, 0]][reach] == depth  # the last step reached is of the node's own depth
    children = begun + (length[row] > depth) + np.where(ends_here, np.r_[0, right[:, 5]][reach], 0)
    parents = [None if p < 0 else int(least[p]) for p in parent]
    digests, open_run = [NONE] * len(row), [-1] * len(row)
    starts = np.flatnonzero(same == 0)
    last = (np.cumsum(kept - lcp) - 1).tolist()
    for i, j in zip(starts.tolist(), [*starts[1:].tolist(), rows]):
        if kept[i] == length[i]:
            if j == rows and one["goes_on"]:
                digests[last[i]], open_run[last[i]] = None, block * size + i
            else:
                digests[last[i]] = hashlib.sha256(",".join(map(str, conv[i:j].tolist())).encode()).hexdigest()
    held = [mine, depth, parents, n, children, of_leaves[stop] - of_leaves[row] + summed[:, 4], saved]
    names = [*[c.split()[0] for c in NODES.split(", ")], "run"]
    return pa.table([*[pa.array(c, pa.int64()) for c in held], pa.array(digests, pa.string()), pa.array(open_run, pa.int64())], names)


def _open_runs(key: tuple, packed: pa.Table, around: pa.Table, size: int) -> pa.Table:
    """(run, at, conv_id) of equal conversations that go on beyond their block."""
    block, one, carry = key[0].as_py(), packed.to_pylist()[0], around.to_pylist()[0]["carry"]
    conv, same = unsqueeze(one["rows"], np.int64).reshape(7, -1)[[0, 6]]
    run = np.maximum.accumulate(np.where(same == 0, block * size + np.arange(len(conv)), carry if same[0] else -1))
    open_ = np.zeros(len(conv), bool)
    if same[0]:
        open_ |= run == carry
    if one["goes_on"]:
        open_ |= run == run[-1]
    return pa.table([pa.array(v[open_]) for v in (run, block * size + np.arange(len(conv)), conv)], ["run", "at", "conv_id"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each run's ids, from rows sorted by (run, at); a run is never held whole."""
    now, digest = None, None
    done = lambda: pa.RecordBatch.from_arrays([pa.array([now]), pa.array([digest.hexdigest()])], ["run", "sha"])
    for batch in batches:
        runs, ids = batch.column("run").to_numpy(), batch.column("conv_id").to_numpy()
        starts = np.flatnonzero(np.r_[True, runs[1:] != runs[:-1]]) if len(runs) else []
        for start, stop in zip(starts, [*starts[1:], len(runs)]):
            text = ",".join(map(str, ids[start:stop].tolist())).encode()
            if runs[start] == now:
                digest.update(b"," + text)
            else:
                if now is not None:
                    yield done()
                now, digest = int(runs[start]), hashlib.sha256(text)
    if now is not None:
        yield done()


def trie(turns: DataFrame, lengths: DataFrame, size: int = BLOCK) -> DataFrame:
    """A row per distinct beginning of the conversations in ``turns`` (conv_id, pos, digest, chars).

    ``lengths`` (conv_id, length) names every conversation once, those without turns as well. A
    node is the sequence of the first ``depth`` turns of its members; its columns are those of
    ``NODES``: smallest member, depth, parent's smallest member, members, children, childless nodes
    of its subtree, characters that keeping each turn of the subtree once saves, and the SHA-256
    of the ids of the members that end with it.

    Conversations are sorted by their turns' digests and cut into blocks. Nodes are the maximal
    intervals of the LCP array whose values reach their depth: a block finds them by nearest
    smaller values with a stack, and one pass over the blocks' minima tells what nodes reach
    beyond. Sums over a subtree are differences of sums over rows: with h the characters that a
    row shares with the row before, those saved below depth d are the sum of h over all members
    but the first, less what they share above d. No group of like conversations is
    held whole: copies stand in as many blocks as they fill, and only the hash of their ids, which
    has one order, streams them through one task.

    The summaries of all blocks (a row for ``size`` conversations) meet in one task. A turn
    that a conversation shares with others costs 16 bytes in its row; turns beyond
    are nodes of their own and never sorted. No conversation gives no rows.
    """
    apart = materialise(told_apart(turns, lengths), "trie-lengths")
    marked = turns.join(apart.select("conv_id", "length", "kept"), "conv_id")
    sorted_by = marked.where("pos < kept").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "chars"))).alias("turns"))
    convs = apart.join(sorted_by, "conv_id", "left").withColumn("turns", F.coalesce("turns", F.array().cast("array<struct<pos:bigint,digest:binary,chars:bigint>>")))
    placed = in_order(convs, F.col("turns.digest"), "conv_id", name="at")
    block = F.floor(F.col("at") / size)
    # The first and the last row of a block also go to its neighbours.
    near = F.array_compact(F.array(block, F.when((F.col("at") % size == 0) & (F.col("at") > 0), block - 1), F.when(F.col("at") % size == size - 1, block + 1)))
    packed = materialise(placed.withColumn("block", F.explode(near)).groupBy("block").applyInArrow(lambda key, rows: _packed(key, rows, size), PACKED), "trie-blocks")
    around = materialise(packed.select("block", "steps", "back", "lowest", "run").coalesce(1).mapInArrow(_around, "of_block long, right binary, left binary, carry long"), "trie-around")
    both = packed.groupBy("block").cogroup(around.groupBy("of_block"))
    nodes = materialise(both.applyInArrow(lambda key, one, other: _nodes(key, one, other, size), f"{NODES}, run long"), "trie-nodes")
    crossing = packed.where("goes_on = 1 or carried = 1").groupBy("block").cogroup(around.join(packed.where("goes_on = 1 or carried = 1").select(F.col("block").alias("of_block")), "of_block", "left_semi").groupBy("of_block"))
    ids = crossing.applyInArrow(lambda key, one, other: _open_runs(key, one, other, size), "run long, at long, conv_id long").repartition("run").sortWithinPartitions("run", "at")
    hashed = ids.mapInArrow(_hashed, "run long, sha string")
    columns = [c.split()[0] for c in NODES.split(", ")]
    ended = nodes.where("run >= 0").drop("ends_sha256").join(hashed.withColumnRenamed("sha", "ends_sha256"), "run").select(columns)
    # Behind the turns sorted by, a conversation is alone.
    end = F.col("pos") + 1 == F.col("length")
    tails = marked.where("pos >= kept").select("conv_id", (F.col("pos") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"), (~end).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.when(end, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(NONE).alias("ends_sha256"))
    return nodes.where("run < 0").select(columns).unionByName(ended).unionByName(tails)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of the conversations rebuilt on shared heads; rows without a conv_id take no part."""
    turns, lengths = with_shared_heads(ordered_turns(table(spark, sf_dir, "conversations")))
    return trie(materialise(turns, "trie-turns"), materialise(lengths, "trie-sizes"))
