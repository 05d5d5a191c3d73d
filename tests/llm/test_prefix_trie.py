import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import prefix_trie, registry

DIR = "/root/testdata/sf0.001"
SHAPE = "conv_id long, turn long, role string, text string"


def plain_trie(held):
    """The nodes of {id: [(role, text), ...]} by grouping every beginning."""
    members, out = defaultdict(list), []
    for c, turns in held.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    below = defaultdict(lambda: [0, 0])
    kids = defaultdict(int)
    for node, ids in members.items():
        kids[node[:-1]] += bool(node)
    for node, ids in members.items():
        for d in range(len(node) + 1):
            below[node[:d]][0] += not kids[node]
            below[node[:d]][1] += (len(ids) - 1) * (len(node[-1][1]) if node else 0)
    for node, ids in members.items():
        ends = ",".join(map(str, sorted(c for c in ids if len(held[c]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(ids), len(node), parent, len(ids), kids[node], *below[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def plain_rebuilt(held):
    out = {}
    for c, turns in held.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = held.get(c - c % 100, [])[:h] + turns[h:]
    return out


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def found_trie(spark, held, size):
    rows = [(c, p, r, t) for c, turns in held.items() for p, (r, t) in enumerate(turns)]
    turns = prefix_trie.ordered_turns(spark.createDataFrame(rows, SHAPE))
    lengths = spark.createDataFrame([(c, len(t)) for c, t in held.items()], "conv_id long, length long")
    return rows_of(prefix_trie.trie(turns, lengths, size))


def some_conversations(seed):
    """Shared beginnings, copies over several blocks, nested and turnless conversations, long ones with long common heads."""
    draw = random.Random(seed)
    turn = lambda: (draw.choice(["user", "bot"]), draw.choice(["", "a", "bé", "ccc"]))
    long = [("user", str(i)) for i in range(150)]
    held = [[turn() for _ in range(draw.randrange(5))] for _ in range(60)]
    held += [[("user", "hello"), ("bot", "hi")]] * 25 + [[("user", "x")] * n for n in range(12)]
    held += [long[: draw.choice([31, 32, 33, 64, 100, 150])] + [turn()] * draw.randrange(3) for _ in range(10)] + [long] * 4
    ids = draw.sample(range(-50, 1000), len(held))
    draw.shuffle(held)
    return dict(zip(ids, held))


@pytest.mark.parametrize("size", [1, 7, 4096])
def test_trie_over_blocks(spark, size):
    held = some_conversations(size)
    assert found_trie(spark, held, size) == plain_trie(held)


def test_same_rows_as_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{DIR}/conversations.parquet'")
    want, found = con.sql(registry.oracle_sql()["op13_prefix_trie"]), prefix_trie.op13_prefix_trie(spark, DIR)
    assert found.columns == want.columns and rows_of(found) == sorted(want.fetchall(), key=str)


def test_odd_conversations(spark):
    rows = [(0, 1, "user", "a"), (0, None, "system", None), (0, 2, None, "b"), (1, 5, "user", "own"), (2, 0, "user", "x" * 300_000), (None, 0, "user", "lost"), (100, 0, "user", "a"), (107, 0, "user", "a"), (107, 1, "user", "b"), (307, 0, "user", "a"), (307, 0, "user", "a")]
    df = spark.createDataFrame(rows, SHAPE)
    df = df.select("*", *[F.lit(1).alias(name) for name in ("pos", "digest", "at", "TEXT", "length")])
    held = defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda r: (r[0] or 0, r[1] is not None, r[1] or 0)):
        if c is not None:
            held[c].append((r or "", x or ""))
    turns, lengths = prefix_trie.with_shared_heads(prefix_trie.ordered_turns(df))
    assert rows_of(prefix_trie.trie(turns, lengths)) == plain_trie(plain_rebuilt(held))


def test_no_conversations(spark):
    turns, lengths = prefix_trie.with_shared_heads(prefix_trie.ordered_turns(spark.createDataFrame([], SHAPE)))
    assert prefix_trie.trie(turns, lengths).collect() == []


def test_nearest_smaller_values():
    lcp, kept = np.array([-1, 1, 3, 3, 0, 2]), np.array([2, 4, 3, 5, 2, 3])
    end, least, begun, parent = prefix_trie.intervals(lcp, kept, kept, np.array([9, 4, 7, 3, 8, 6]))
    # Row 0 begins depths 0 to 2, row 1 2 to 4, row 3 4 and 5, row 4 1 and 2, row 5 3.
    assert end.tolist() == [6, 3, 0, 3, 3, 1, 3, 3, 6, 6, 6]
    assert least.tolist() == [3, 3, 9, 3, 3, 4, 3, 3, 6, 6, 6]
    assert begun.tolist() == [1, 1, 0, 0, 1, 0, 0, 0, 0, 1, 0]
    assert parent.tolist() == [-1, 0, 1, 1, 3, 4, 4, 6, 0, 8, 9]
