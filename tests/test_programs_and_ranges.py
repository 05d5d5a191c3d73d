import sys

import pytest
from pyspark.sql import functions as F

from tidemill.operators import blocks, catalog, grep, programs, ring, table_functions
from tidemill.functions.text import grep_pattern
from tidemill.sources import block_store

COUNT = "import sys\nn = 0\nfor line in sys.stdin:\n    n += 1\n    print('n', n, sep='\\t')\n"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_one_program_serves_a_whole_partition(spark):
    df = spark.range(25_000).select(F.col("id").cast("string").alias("key"), F.lit("x").alias("value")).coalesce(1)
    found = programs.external(df, [sys.executable, "-c", COUNT]).agg(F.max(F.col("value").cast("int")), F.count("*")).first()
    assert tuple(found) == (25_000, 25_000)


def test_lines_stream_through_a_program():
    """Answers come while input goes on without an end, and no more of it is taken than pipes hold."""
    taken = []

    def endless():
        while True:
            taken.append(1)
            yield "y" * 1000

    found = programs.streamed(["cat"], endless())
    assert [next(found) for _ in range(3)] == ["y" * 1000] * 3
    found.close()
    assert len(taken) < 5000


def test_programs_that_fail():
    run = lambda code, lines=("a",), **o: list(programs.streamed([sys.executable, "-c", code], lines, **o))
    with pytest.raises(RuntimeError, match="ended with 3\nwrong"):
        run("import sys; print('wrong', file=sys.stderr); sys.exit(3)")
    with pytest.raises(TimeoutError, match="did nothing for 0.5 seconds"):
        run("import time; time.sleep(60)", timeout=0.5)
    assert run("print('done')", ("a" * 1000 for _ in range(10_000))) == ["done"]  # stops reading early

    def bad():
        yield "a"
        raise KeyError("input")

    with pytest.raises(KeyError, match="input"):
        run("import sys; sys.stdin.read()", bad())
    assert run("import sys; sys.stdout.write(sys.stdin.read())", ["é\u2028x\r", ""]) == ["é\u2028x\r", ""]


def test_programs_and_odd_tuples(spark):
    df = spark.createDataFrame([("k", "v\tw"), (None, None), ("a", "")], "key string, value string")
    assert rows(programs.external(df.coalesce(1), ["cat"])) == [("", ""), ("a", ""), ("k", "v\tw")]
    assert programs.external(df.where("false"), ["false"]).collect() == []


def test_table_functions(spark):
    table_functions.register(spark)
    t = spark.createDataFrame([(1, "a,ba,c,"), (2, None), (3, "x")], "id int, v string")
    assert rows(spark.sql("select id, pos, field from {t}, lateral fields_with(v, 'a')", t=t)) == [(1, 0, "a"), (1, 1, "ba")]
    assert spark.sql("select * from {t}, lateral fields_with(v, '')", t=t).count() == 5
    g = spark.createDataFrame([("a", 3), ("b", 1), ("a", 1), (None, 7), ("a", 2)], "grp string, id long")
    found = spark.sql("select * from count_in_order(table(select * from {g}) partition by grp order by id)", g=g)
    assert rows(found) == [("a", 1, 1), ("a", 2, 2), ("a", 3, 3), ("b", 1, 1), (None, 7, 1)]


@pytest.mark.parametrize("gone", [[0], [3, 4, 5, 6, 7], list(range(9)), list(range(10))])
def test_moves_equal_two_placements(spark, gone):
    files = spark.range(300).select(F.concat(F.lit("f"), "id").alias("file"))
    nodes = spark.range(10).select(F.concat(F.lit("n"), "id").alias("node"), "id")
    fewer = nodes.where(~F.col("id").isin(gone))
    for a, b in ((nodes, fewer), (fewer, nodes)):
        assert rows(ring.moves(files, a, b)) == rows(ring.rebalance(ring.placement(files, a), ring.placement(files, b))) != []


def test_moved_arcs_are_few(spark):
    nodes = spark.range(100).select(F.concat(F.lit("n"), "id").alias("node"), "id")
    assert ring.moved_arcs(nodes, nodes.where("id <> 7")).count() <= 4 and ring.moved_arcs(nodes, nodes).count() == 0


def test_byte_ranges(spark):
    data = {"f": [b"abc", b"", b"d\x00\xff", b"ghijkl", None, b"m"], "g": [b"xy"], "empty": [b""]}
    held = spark.createDataFrame([(f, i + 1, b) for f, parts in data.items() for i, b in enumerate(parts)], "file string, pos long, data binary")
    wanted = [(f, o, n) for f in ("f", "g", "empty", "none") for o in (0, 1, 3, 6, 12, 13, 50) for n in (0, 1, 4, 13, 99)]
    df = spark.createDataFrame(wanted + [("f", 1, 4)], "file string, offset long, length long")
    for cell in (2, 1 << 20):
        found = {(r["file"], r["offset"], r["length"]): r["bytes"] for r in blocks.byte_ranges(blocks.block_index(held), df, cell).collect()}
        for f, o, n in wanted:
            whole = b"".join(b or b"" for b in data[f]) if f in data else None
            assert found[f, o, n] == (None if whole is None else whole[o : o + n])
    with pytest.raises(Exception, match="numbers from 0"):
        blocks.byte_ranges(blocks.block_index(held), spark.createDataFrame([("f", -1, 2)], df.schema)).collect()


def test_runs_of_sequences(spark, monkeypatch):
    seqs = {"a": [0, 1, 2, 5, 6, 9, 9], "b": [3], "c": list(range(40))}
    df = spark.createDataFrame([(c, s) for c, held in seqs.items() for s in held] + [("b", None)], "client string, seq long")
    for cell in (4, 1 << 20):
        monkeypatch.setattr(blocks, "CELL", cell)
        assert rows(blocks.sequence_ranges(df)) == sorted([("a", 0, 2, 3), ("a", 5, 6, 2), ("a", 9, 9, 1), ("b", 3, 3, 1), ("c", 0, 39, 40)], key=str)


def copies(spark, *held):
    return spark.createDataFrame([(f, 0, b, "c", s, 1, "d") for f, b, s in held], "file string, replica int, block_id long, client string, seq long, ts long, data string")


def test_merging_returns_only_its_own_files(spark, tmp_path):
    path = str(tmp_path / "out")
    catalog.merge_files(copies(spark, ("f1", 1, 0)), str(tmp_path / "s1"), path)
    second = catalog.merge_files(copies(spark, ("f2", 2, 0), ("f2", 3, 1)), str(tmp_path / "s2"), path)
    assert sorted(r["block_id"] for r in second.collect()) == [2, 3]
    assert spark.read.parquet(path).count() == 3


def test_block_store_round_trip(spark, tmp_path):
    held = spark.createDataFrame([("f", f"b{i}", "c", i, 10 + i, "tekst é" * i) for i in range(6)], "file string, block_id string, client string, seq long, ts long, data string")
    block_store.write_metadata(held, str(tmp_path / "m"), per_row=2)
    block_store.write_block_texts(held.where("seq <> 4"), str(tmp_path / "b"))
    (tmp_path / "b" / "b4.blk").write_bytes(b"\x00\xff\n")
    found = {r["block_id"]: (r["file"], r["seq"], r["ts"], bytes(r["data"]), r["size"]) for r in block_store.read_store(spark, str(tmp_path / "m"), str(tmp_path / "b")).collect()}
    assert found.pop("b4") == ("f", 4, 14, b"\x00\xff\n", 32)
    assert found == {f"b{i}": ("f", i, 10 + i, ("tekst é" * i).encode(), 8 * i) for i in (0, 1, 2, 3, 5)}
    (tmp_path / "b" / "b4.blk").unlink()
    assert block_store.read_store(spark, str(tmp_path / "m"), str(tmp_path / "b")).count() == 5


#: Pattern, whether extended, line and what grep -o prints of it.
ONLY = [
    ("a|ab", True, "ab", ["ab"]), ("(a|ab)(c|bcd)", True, "abcd", ["abcd"]), ("(a*)(ab)*", True, "aab", ["aab"]), (r"a\|ab", False, "xab", ["ab"]),
    ("foo|foobar|bar", True, "foobarfoo", ["foobar", "foo"]), ("a{", True, "a{", ["a{"]), ("x{2", True, "x{2", ["x{2"]), ("a{,2}b", True, "aaab", ["aab"]),
    ("a**", True, "aab", ["aa"]), ("a+*", True, "aab", ["aa"]), ("x{2}{1}", True, "xxx", ["xx"]), ("[[:alpha:]]+", True, "É é1", ["É", "é"]),
    ("[[:punct:]]", True, "a$b", ["$"]), (r"\<the\>", True, "éthe the the_", ["the"]), ("*b", False, "a*b", ["*b"]), (r"a\{2\}", False, "aaa", ["aa"]), ("a+", False, "aa+", ["a+"]),
]


@pytest.mark.parametrize("pattern, extended, line, want", ONLY)
def test_only_the_longest_match(spark, pattern, extended, line, want):
    df = spark.createDataFrame([("f", 1, line), ("f", 2, None)], "file string, line_no int, line string")
    assert [r["line"] for r in grep.grep_only(df, pattern, extended=extended).collect()] == want
    assert grep.grep(df, pattern, extended=extended).count() == 1


@pytest.mark.parametrize("pattern, extended", [("(a", True), (r"\(a", False), ("a)", True), (r"a\)", False), ("[a", True), ("a\\", True), ("*a", True), ("a|*", True), ("a{3,1}", True), (r"\{1\}", False)])
def test_bad_patterns_fail_while_planning(pattern, extended):
    with pytest.raises(ValueError):
        grep_pattern(pattern, extended)


def test_search_options(spark):
    df = spark.createDataFrame([("f", 1, "éthe"), ("f", 2, "THE end"), ("g", 1, "un a.b"), ("h", 1, None)], "file string, line_no int, line string")
    assert rows(grep.files_with(df, ["the", "a.b"], fixed=True, word=True, ignore_case=True)) == [("f",), ("g",)]
    assert rows(grep.files_with(df, "the", without=True)) == [("g",), ("h",)]
    only = lambda p, **o: [r["line"] for r in grep.grep_only(df, p, **o).collect()]
    assert only("the", word=True, ignore_case=True) == ["THE"] and only("the|th", extended=True, ignore_case=True) == ["the", "THE"]
    assert only("a.b", fixed=True) == ["a.b"] and only(["a.", "a.b"], fixed=True) == ["a.b"] and only("un a.b|x", extended=True, whole_line=True) == ["un a.b"]
    with pytest.raises(ValueError):
        grep.grep(df, [])


def test_rates_of_all_tasks(spark):
    tasks = spark.createDataFrame([(1,), (2,)], "task long")
    reported = spark.createDataFrame([(1, 5.0, 1), (1, 7.0, 2), (3, 9.0, 1)], "task long, rate double, ts long")
    assert rows(catalog.with_rates(tasks, reported)) == [(1, 7.0), (2, 0.0)]


def test_upserts_of_maps(spark):
    from tidemill.operators import tuples

    df = spark.createDataFrame([({"a": 1, "b": 2}, "a", 9), ({}, "x", 1), (None, "x", 1), ({"a": 1}, None, 5), ({"a": 1}, "a", None)], "m map<string,int>, k string, v int")
    assert [r[0] for r in df.select(tuples.upserted("m", "k", "v")).collect()] == [{"b": 2, "a": 9}, {"x": 1}, {"x": 1}, {"a": 1}, {"a": None}]


def test_binary_content_of_one_replica(spark):
    held = [("f", r, b, "c", b, 1, bytes([b, 255])) for r in (0, 1) for b in range(5) if (r, b) != (1, 3)] + [("f", 1, 0, "c", 0, 1, bytes([0, 255]))]
    df = spark.createDataFrame(held, "file string, replica int, block_id long, client string, seq long, ts long, data binary")
    found = blocks.content(blocks.of_replica(df, 1), per_segment=2).orderBy("start").collect()
    assert b"".join(bytes(r["data"]) for r in found) == b"\x00\xff\x01\xff\x02\xff\x04\xff" and [r["start"] for r in found][0] == 0
