import pytest

from tidemill.operators import grep


@pytest.mark.parametrize(
    ("pattern", "options", "expected"),
    [("foo$", {}, ["foo"]), ("a.b", {}, ["a\rb", "a\u2028b"]), ("é", {"ignore_case": True}, ["É"]), ("foo", {"whole_line": True}, ["foo"])],
)
def test_lines_hold_other_separators_and_letters(spark, pattern, options, expected):
    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate(("foo", "foo\r", "a\rb", "a\u2028b", "É"))], "file string, line_no int, line string")
    assert sorted(r["line"] for r in grep.grep(lines, pattern, **options).collect()) == sorted(expected)
