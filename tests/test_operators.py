import hashlib

import pytest
from pyspark.sql import functions as F

from tidemill.operators import blocks, catalog, grep, members, programs, rates, ring, tuples
from tidemill.sources import files

REPLICAS = 3


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def kv(spark, *values):
    return spark.createDataFrame([(f"k{i}", v, i) for i, v in enumerate(values)], "key string, value string, line_num long")


def test_filter_is_literal_and_keeps_case(spark):
    df = kv(spark, "a.b", "axb", "ABC")
    assert [r["value"] for r in tuples.filter_literal(df, ".").collect()] == ["a.b"]
    assert not tuples.filter_literal(df, "abc").collect()


def test_running_and_final_count(spark):
    df = kv(spark, "x,a", "y,a", "z,b", "w")
    assert rows(tuples.running_count(df, 1)) == [(0, "a", 1), (1, "a", 2), (2, "b", 1), (3, "", 1)]
    assert rows(tuples.final_count(df, 1)) == [("", 1), ("a", 2), ("b", 1)]


def test_dispatch_fails_while_planning(spark):
    df = kv(spark, "a")
    with pytest.raises(ValueError):
        tuples.apply_operator(df, "filter", [])
    with pytest.raises(ValueError):
        tuples.apply_operator(df, "nothing", [])
    assert tuples.apply_operator(df, "identity", []).columns == ["key", "value"]


def test_external_program(spark):
    out = programs.external(kv(spark, "b a", "c"), ["tr", "a-c", "A-C"])
    assert rows(out) == [("k0", "B A"), ("k1", "C")]
    own = programs.external(kv(spark, "b", "c"), ["cut", "-f2"], per_tuple=True)
    assert rows(own) == [("k0", "b"), ("k1", "c")]
    assert rows(programs.external(kv(spark, "b", "c"), ["cut", "-f2"])) == [("", "b"), ("", "c")]
    with pytest.raises(Exception, match="ended with 1"):
        programs.external(kv(spark, "b"), ["false"]).collect()


def lines(spark, *texts):
    return spark.createDataFrame([("f", i + 1, t) for i, t in enumerate(texts)], "file string, line_no int, line string")


def test_grep_options(spark):
    df = lines(spark, "the cat", "other", "THE", "", "a+b")
    numbers = lambda **o: [r["line_no"] for r in grep.grep(df, **o).orderBy("line_no").collect()]
    assert numbers(pattern="the") == [1, 2]
    assert numbers(pattern="the", ignore_case=True) == [1, 2, 3]
    assert numbers(pattern="the", word=True) == [1]
    assert numbers(pattern="other", whole_line=True) == [2]
    assert numbers(pattern="a+b", fixed=True) == [5]
    assert numbers(pattern="the", invert=True) == [3, 5]
    assert numbers(pattern="e", first=1) == [1]
    assert [r["line_no"] for r in grep.grep_context(df, "other", 1, 1, ("file",)).collect()] == [1, 2, 3]
    assert {(r["file"], r["n"]) for r in grep.counts_and_total(grep.grep(df, "the")).collect()} == {("f", 2), (None, 2)}


def plain_placement(names, nodes):
    pos = lambda x: hashlib.sha1(x.encode()).hexdigest()
    ordered = sorted(nodes, key=pos)
    out = []
    for f in names:
        at = next((i for i, n in enumerate(ordered) if pos(n) >= pos(f)), 0)
        out += [(f, ordered[(at + k) % len(ordered)], k + 1) for k in range(min(REPLICAS, len(ordered)))]
    return sorted(out)


@pytest.mark.parametrize("n", [1, 2, 5, 40])
def test_placement_against_a_walk_around_the_ring(spark, n):
    names, nodes = [f"file{i}" for i in range(60)] + ["node1"], [f"node{i}" for i in range(n)]
    placed = ring.placement(spark.createDataFrame([(f,) for f in names], "file string"), spark.createDataFrame([(x,) for x in nodes], "node string"))
    assert rows(placed) == plain_placement(names, nodes)


def test_moves_read_the_ring_once(spark):
    """No frame starts at each node anew, and the moves are the differences of two walks around the ring."""
    names, nodes = [f"file{i}" for i in range(60)] + ["node1"], [f"node{i}" for i in range(12)]
    frame = lambda values, name: spark.createDataFrame([(x,) for x in values], f"{name} string")
    by_place = sorted(nodes, key=lambda x: hashlib.sha1(x.encode()).hexdigest())
    for lost in ([by_place[0]], [by_place[-1]], by_place[3:6], by_place[2:], []):
        left = [x for x in nodes if x not in lost]
        moved = ring.moves(frame(names, "file"), frame(nodes, "node"), frame(left, "node"))
        had, has = ({(f, x) for f, x, _ in plain_placement(names, of)} for of in (nodes, left))
        assert rows(moved) == sorted([(*c, "fetch") for c in has - had] + [(*c, "delete") for c in had - has])
    assert "currentrow$(), unboundedfollowing" not in moved._jdf.queryExecution().analyzed().toString()


def test_merge_order_and_earliest_copy(spark):
    held = [("f", 0, "b1", "vmA", 0, 5, "x"), ("f", 1, "b1", "vmA", 0, 4, "y"), ("f", 0, "b2", "create", 0, 0, "c"), ("f", 0, "b3", "172.1", 0, 9, "i"), ("f", 2, "b2", "create", 0, 0, "c")]
    df = spark.createDataFrame(held, "file string, replica int, block_id string, client string, seq long, ts long, data string")
    assert [(r["client"], r["data"]) for r in blocks.merged(df).orderBy("pos").collect()] == [("172.1", "i"), ("create", "c"), ("vmA", "y")]
    assert [r["client"] for r in blocks.merged(df, create_first=True).orderBy("pos").collect()][0] == "create"
    parts = blocks.content(blocks.merged(df), 2).orderBy("segment").collect()
    assert [(r["start"], r["data"]) for r in parts] == [(0, "ic"), (2, "y")]


def test_order_and_gaps(spark):
    df = spark.createDataFrame([("f", "a", s, i) for i, s in enumerate([0, 1, 1, 3])], "file string, client string, seq long, pos long")
    assert [r["pos"] for r in blocks.order_violations(df).collect()] == [2]
    assert rows(blocks.sequence_gaps(df)) == [("a", 3, 1)]


def test_block_files_are_created_once_and_appended(spark, tmp_path):
    df, path = spark.createDataFrame([("f", 1)], "file string, n int"), str(tmp_path / "blocks")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        blocks.append_blocks(df, path)
    blocks.create_file(df, path)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        blocks.create_file(df, path)
    blocks.append_blocks(df, path)
    assert spark.read.parquet(path).count() == 2


def test_latest_version_keeps_the_first_of_equal_ones(spark):
    df = spark.createDataFrame([("h", 1, 5, 0, "A"), ("h", 1, 5, 1, "B"), ("h", 0, 9, 2, "C"), ("g", 0, 0, 3, "D")], "host string, incarnation int, heartbeat int, arrival int, status string")
    assert rows(members.merge_versions(df, "status").select("host", "status")) == [("g", "D"), ("h", "A")]


def test_hosts_fall_back(spark):
    m = spark.createDataFrame([("vm1.x",), ("vm2",), ("other",)], "host string")
    v = spark.createDataFrame([("vm1.x", 11), ("vm2.y", 12)], "hostname string, vm int")
    assert rows(members.hosts_of(m, v)) == [("other", 1), ("vm1.x", 11), ("vm2", 12)]


def test_scaling_decisions(spark):
    held = [("up", False, 200)] * 2 + [("full", False, 200)] * 10 + [("down", False, 10), ("down", False, None), ("one", False, 0), ("held", True, 900)]
    df = spark.createDataFrame(held, "stage string, stateful boolean, rate long")
    assert {r["stage"]: r["decision"] for r in rates.decisions(df, 50, 150).collect()} == {"up": "UP", "full": "HOLD", "down": "DOWN", "one": "HOLD", "held": "HOLD"}


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b" x \r\n\r\ny")
    assert rows(files.tuple_source(spark, str(tmp_path / "a.txt")).select("key", "value")) == [("a.txt:0", "x"), ("a.txt:2", "y")]
    logs = spark.createDataFrame([("[2024-01-02 03:04:05.678] [leader] up",), ("[2024-01-02 03:04:05.678] plain",)], "line string")
    assert {(r["tag"], r["message"]) for r in files.log_lines(logs).collect()} == {("leader", "up"), ("", "plain")}


def test_literal_filter_reaches_the_scan(spark, tmp_path):
    kv(spark, "a", "b").write.parquet(str(tmp_path / "t"))
    df = tuples.filter_literal(spark.read.parquet(str(tmp_path / "t")), "a").select("key")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "StringContains(value,a)" in plan and "line_num" not in plan.split("ReadSchema")[1]
    assert df.select(F.count("*")).first()[0] == 1


def test_catalog(spark, tmp_path):
    path = str(tmp_path / "files")
    df = lambda *r: spark.createDataFrame(list(r), "file string, block_id int, data string")
    catalog.replace_blocks(df(("f", 1, "a"), ("g", 2, "b")), path)
    catalog.replace_blocks(df(("f", 3, "c")), path)
    held = spark.read.parquet(path).select("file", "block_id")
    assert rows(held) == [("f", 3), ("g", 2)]
    assert rows(catalog.without_files(held, df(("f", 0, "")))) == [("g", 2)]
    assert rows(catalog.existing(df(("f", 9, ""), ("h", 9, "")), held).select("file")) == [("f",)]
    listed = spark.createDataFrame([(1,), (2,)], "block_id int")
    assert rows(catalog.stored_blocks(listed, df(("f", 1, "a")))) == [(1, "a")]
    hosts = spark.createDataFrame([("a", "1"), ("x", "2"), ("y", "3")], "host string, ip string")
    vms = spark.createDataFrame([(1, "a", "9"), (2, "b", "2")], "vm int, hostname string, ip string")
    assert {(r["host"], r["vm"]) for r in catalog.own_machine(hosts, vms).collect()} == {("a", 1), ("x", 2), ("y", None)}


def test_positional_zip(spark):
    a = spark.createDataFrame([(2, "y"), (1, "x")], "i int, v string")
    b = spark.createDataFrame([(5, "p"), (7, "q")], "i int, v string")
    assert [(r["left"]["v"], r["right"]["v"]) for r in catalog.zipped(a, b, "i", "i").orderBy("position").collect()] == [("x", "p"), ("y", "q")]
    with pytest.raises(Exception, match="differ in length"):
        catalog.zipped(a, b.limit(1), "i", "i").collect()
