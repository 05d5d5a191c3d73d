import pytest

from tidemill.operators import blocks, catalog, grep, members, tuples
from tidemill.sources import files


def test_lines_are_numbered_over_many_splits(spark, tmp_path):
    lines = [f"{i} " + "x" * (i % 50) for i in range(2000)]
    (tmp_path / "a.txt").write_text("\n".join(lines))
    (tmp_path / "b.txt").write_bytes(b"one\r\ntwo\n\nfour\n")
    (tmp_path / "empty.txt").write_text("")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        held = files.lines_with_numbers(spark, str(tmp_path), 1)
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 3
        found = sorted(map(tuple, held.collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found == [("a.txt", i, x) for i, x in enumerate(lines, 1)] + [("b.txt", i, x) for i, x in enumerate(["one", "two", "", "four"], 1)]
    assert [r["line"] for r in files.lines_with_numbers(spark, str(tmp_path / "b.txt"), separator="\n").orderBy("line_no").collect()] == ["one\r", "two", "", "four"]


def test_running_counts_go_on_over_cells(spark):
    size = tuples.CELL * 2 + 5
    df = spark.range(size).selectExpr("id as line_num", "if(id % 1000 = 0, 'b,x', 'a,y') as value")
    found = tuples.running_count(df, 0)
    a, b = (found.where(f"grp = '{g}'").selectExpr("count(*) as rows", "max(n) as most", "count(distinct n) as n", "min(n) as least").first() for g in "ab")
    assert tuple(b) == (len(range(0, size, 1000)),) * 3 + (1,)
    assert tuple(a) == (size - len(range(0, size, 1000)),) * 3 + (1,)
    assert found.where("line_num = 131000").first()["n"] == 132


def test_responses_hold_full_counts_and_first_lines(spark):
    rows = [("f", i, f"hit {i}") for i in range(300)] + [("g", 0, "none"), (None, 0, "hit")]
    found = grep.response(spark.createDataFrame(rows, "file string, line_no int, line string"), "hit", most=3)
    got = sorted(map(tuple, found.collect()), key=str)
    assert got == sorted([("f", 300, i, f"hit {i}") for i in range(3)] + [("g", 0, None, None), (None, 1, 0, "hit")], key=str)


def test_hosts_by_prefix_of_machines(spark):
    named = spark.createDataFrame([("vm1.x", 11), ("vm1.x", 13), ("vm2.x", 12), ("vm", 20)], "hostname string, vm int")
    hosts = spark.createDataFrame([("vm1.x",), ("vm2a.y",), ("vm",), ("",), (None,), ("other",)], "host string")
    assert {tuple(r) for r in members.hosts_of(hosts, named).collect()} == {("vm1.x", 11), ("vm2a.y", 12), ("vm", 20), ("", 1), (None, 1), ("other", 1)}


def test_content_starts_where_earlier_segments_end(spark):
    df = spark.createDataFrame([("f", p, "é" * p) for p in range(1, 8)], "file string, pos int, data string")
    parts = blocks.content(df, 3).orderBy("segment").collect()
    assert [(r["start"], r["length"]) for r in parts] == [(0, 12), (12, 30), (42, 14)]


def test_merge_job_rewrites_or_refuses(spark, tmp_path):
    kind = "file string, replica int, block_id long, client string, seq long, ts long, data string"
    good = spark.createDataFrame([("1", r, b, "c", b, 10 + r, "d") for r in (0, 1) for b in (0, 1)], kind)
    done = catalog.merge_files(good, str(tmp_path / "s1"), str(tmp_path / "out"))
    assert sorted((r["file"], r["block_id"], r["pos"], r["ts"]) for r in done.collect()) == [("1", 0, 1, 10), ("1", 1, 2, 10)]
    bad = spark.createDataFrame([("1", 0, b, "c", 0, 10, "d") for b in (5, 6)], kind)
    with pytest.raises(ValueError):
        catalog.merge_files(bad, str(tmp_path / "s2"), str(tmp_path / "out"))
    assert done.count() == 2
