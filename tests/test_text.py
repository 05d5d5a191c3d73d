import re

import pytest
from pyspark.sql import functions as F

from tidemill.functions.text import csv_field, first_fields, grep_pattern, legacy_args, numbered, parse_kv, split_lines, strip_ws


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "v string").select(column.alias("c")).first()["c"]


@pytest.mark.parametrize("text,index,expected", [(" x , y ,z", 0, "x"), (" x , y ,z", 1, "y"), (" x , y ,z", 99, ""), (" x , y ,z", -1, "z"), (" x , y ,z", -9, ""), ('"a,b",c', 1, 'b"'), ("", 0, ""), ("a,,", 2, "")])
def test_csv_field(spark, text, index, expected):
    assert one(spark, text, csv_field("v", index)) == expected


@pytest.mark.parametrize("text,expected", [("a,b,c,d", "a,b,c"), ("a,b", "a,b"), ("a", "a"), ("a,,", "a,,"), (" a , b", " a , b")])
def test_first_fields(spark, text, expected):
    assert one(spark, text, first_fields("v")) == expected


def test_strip_takes_all_unicode_space(spark):
    assert one(spark, " \t a b \n ", strip_ws("v")) == "a b"


@pytest.mark.parametrize("text,expected", [("k\tv\tw", ("k", "v\tw")), ("v", ("in", "v")), ("k\t", ("k", ""))])
def test_parse_kv(spark, text, expected):
    key, value = parse_kv("v", F.lit("in"))
    row = spark.createDataFrame([(text,)], "v string").select(key.alias("k"), value.alias("w")).first()
    assert tuple(row) == expected


@pytest.mark.parametrize("text,expected", [("a\r\nb\n", ["a", "b"]), ("a\n\nb", ["a", "", "b"]), ("a\rb", ["a", "b"]), ("", [""])])
def test_split_lines(spark, text, expected):
    assert one(spark, text, split_lines("v")) == expected


@pytest.mark.parametrize(
    "pattern,extended,hits,misses",
    [
        ("foo+bar", False, ["foo+bar"], ["foobar", "fooobar"]),
        ("foo+bar", True, ["foobar", "fooobar"], ["foo+bar"]),
        (r"foo\+bar", False, ["foobar", "fooobar"], ["foo+bar"]),
        (r"foo\+bar", True, ["foo+bar"], ["foobar"]),
        ("a|b", False, ["a|b"], ["a"]),
        (r"\(ab\)*c$", False, ["ababc"], ["abx"]),
        ("*a", False, ["*a"], ["b"]),
        ("[[:digit:]]\\{2\\}", False, ["x12"], ["x1"]),
        ("[]x]", True, ["]", "x"], ["y"]),
        ("a^b", False, ["a^b"], ["ab"]),
        (r"\<the\>", False, ["of the end"], ["other"]),
    ],
)
def test_grep_pattern(spark, pattern, extended, hits, misses):
    java = grep_pattern(pattern, extended)
    rows = spark.createDataFrame([(x,) for x in hits + misses], "v string").where(F.col("v").rlike(java)).collect()
    assert sorted(r["v"] for r in rows) == sorted(hits)


@pytest.mark.parametrize("pattern", ["[ab", "a\\"])
def test_bad_patterns_fail_while_planning(pattern):
    with pytest.raises(ValueError, match=re.escape("pattern")):
        grep_pattern(pattern)


def test_legacy_args():
    assert legacy_args("filter:a b:c") == ("filter", ["a", "b"])
    assert legacy_args("identity") == ("identity", [])


def test_numbered_is_contiguous(spark):
    df = spark.range(100).select((F.col("id") * 7 % 100).alias("x"))
    rows = numbered(df, F.floor(F.col("x") / 13), "x").collect()
    assert sorted((r["x"], r["line_num"]) for r in rows) == [(i, i) for i in range(100)]
