"""Log search over (file, line_no, line) rows."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WORD, grep_pattern, many_ways

#: Parts that a file's matches are dealt over before the first are chosen.
PARTS = 64


def java_pattern(patterns: str | list[str], *, extended: bool = False, fixed: bool = False, ignore_case: bool = False, word: bool = False, whole_line: bool = False) -> str:
    """What the options of a search mean as one Java pattern; several patterns are alternatives."""
    each = [patterns] if isinstance(patterns, str) else list(patterns)
    if not each:
        raise ValueError("a search needs a pattern")
    quoted = lambda p: r"\Q" + p.replace(r"\E", r"\E\\E\Q") + r"\E"
    java = "|".join(quoted(p) if fixed else grep_pattern(p, extended) for p in each)
    if word:
        java = rf"(?<!{WORD})(?:{java})(?!{WORD})"
    if whole_line:
        java = rf"^(?:{java})$"
    # Only a newline ends a line for grep; letters beyond ASCII are letters and have cases too.
    return f"(?dU{'iu' if ignore_case else ''}){java}"


def matcher(pattern: str | list[str], *, invert: bool = False, **options: bool) -> Column:
    """Condition on ``line``. A literal pattern without further conditions stays a plain substring test."""
    line = F.col("line")
    if isinstance(pattern, str) and options.get("fixed") and not any(options.get(o) for o in ("ignore_case", "word", "whole_line")):
        found = line.contains(F.lit(pattern))
    else:
        found = line.rlike(java_pattern(pattern, **options))
    return ~found if invert else found


def grep(lines: DataFrame, pattern: str, *, first: int | None = None, by: tuple[str, ...] = ("file",), order: tuple[str, ...] = ("line_no",), **options: bool) -> DataFrame:
    """Matching lines that aren't empty; with ``first``, at most so many for each ``by``."""
    found = lines.where(matcher(pattern, **options) & (F.col("line") != ""))
    if first is None:
        return found
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return found.withColumn("_rank", rank).where(F.col("_rank") <= first).drop("_rank")


def _longest(java: str) -> Callable:
    """Every longest match from left to right, by POSIX's rule."""

    @F.arrow_udf("array<string>")
    def found(lines: pa.Array) -> pa.Array:
        compiled = regex.compile(java, regex.POSIX)
        return pa.array([None if x is None else [m for m in (m[0] for m in compiled.finditer(x)) if m] for x in lines.to_pylist()], pa.list_(pa.string()))

    return found


def grep_only(lines: DataFrame, pattern: str | list[str], **options: bool) -> DataFrame:
    """Every match on a line of its own: of those at one place the longest. Options are those of ``matcher``.

    Java takes the first alternative that matches. Where that may not be the longest, lines that
    match at all go to a POSIX matcher in Arrow batches; other patterns stay in the JVM.
    """
    java = java_pattern(pattern, **options)
    each = [pattern] if isinstance(pattern, str) else pattern
    held = lines.where(F.col("line").rlike(java))
    if len(each) > 1 or not options.get("fixed") and many_ways(each[0], options.get("extended", False)):
        bare = "|".join(regex.escape(p) if options.get("fixed") else grep_pattern(p, options.get("extended", False)) for p in each)
        bare = rf"(?<!{WORD})(?:{bare})(?!{WORD})" if options.get("word") else bare
        bare = rf"^(?:{bare})$" if options.get("whole_line") else bare
        every = _longest(f"(?i){bare}" if options.get("ignore_case") else bare)("line")
    else:
        every = F.regexp_extract_all("line", F.lit(java), F.lit(0))
    return held.withColumn("line", F.explode(every)).where("line <> ''")


def files_with(lines: DataFrame, pattern: str | list[str], without: bool = False, **options: bool) -> DataFrame:
    """(file): the files that hold a matching line, or with ``without`` those that hold none (``-l`` and ``-L``)."""
    hit = F.max(F.coalesce(matcher(pattern, **options), F.lit(False)))
    return lines.groupBy("file").agg(hit.alias("hit")).where(~F.col("hit") if without else F.col("hit")).select("file")


def grep_context(lines: DataFrame, pattern: str, before: int, after: int, by: tuple[str, ...], order: str = "line_no", **options: bool) -> DataFrame:
    """Matching lines and those at most ``before`` ahead of or ``after`` behind one."""
    hit = F.max(matcher(pattern, **options).cast("int"))
    near = hit.over(Window.partitionBy(*by).orderBy(order).rowsBetween(-after, before))
    return lines.withColumn("_near", near).where("_near = 1").drop("_near")


def numbered_output(lines: DataFrame) -> DataFrame:
    return lines.withColumn("out", F.concat_ws(":", "file", F.col("line_no").cast("string"), "line"))


def counts_and_total(found: DataFrame) -> DataFrame:
    """Matches of each file, and of all under a null file."""
    return found.rollup("file").agg(F.count(F.lit(1)).alias("n"))


def response(lines: DataFrame, pattern: str, most: int = 1000, order: tuple[str, ...] = ("line_no",), **options: bool) -> DataFrame:
    """(file, count, line_no, line): the first ``most`` matching lines of each file, with the count of all.

    A file without a match has one row, count zero and nulls. Every group of lines keeps only
    its first ``most`` before the file's are put together, so a hot file is many tasks' work.
    Sort by (file, line_no) to print.
    """
    found = lines.where(matcher(pattern, **options) & (F.col("line") != ""))
    counts = lines.groupBy("file").agg(F.count_if(matcher(pattern, **options) & (F.col("line") != "")).alias("count"))
    spread = found.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(PARTS)))
    early = F.row_number().over(Window.partitionBy("file", "_part").orderBy(*order))
    early = spread.withColumn("_early", early).where(F.col("_early") <= most)
    rank = F.row_number().over(Window.partitionBy("file").orderBy(*order))
    kept = early.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank", "_early", "_part")
    return counts.join(kept.withColumnRenamed("file", "_of"), F.col("file").eqNullSafe(F.col("_of")), "left").drop("_of")
