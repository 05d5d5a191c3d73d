"""Text expressions: white space, tuples, positional CSV fields, lines, grep patterns."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: POSIX bracket classes and what stands for them in a Java class with Unicode properties; fixed by POSIX.
POSIX_CLASSES = {"alpha": r"\p{Alpha}", "digit": "0-9", "alnum": r"\p{Alpha}\p{Nd}", "upper": r"\p{Upper}", "lower": r"\p{Lower}", "space": r"\s", "punct": r"\p{P}\$\+<=>\^`\|~", "blank": r"\p{Blank}", "cntrl": r"\p{Cntrl}", "print": r"\p{Print}", "graph": r"\p{Graph}", "xdigit": "0-9A-Fa-f"}
#: Parts of words, for ``-w`` and word edges.
WORD = r"[\p{L}\p{M}\p{N}_]"


def strip_ws(c: Column | str) -> Column:
    """Without leading and trailing Unicode white space (``trim`` takes spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def parse_kv(line: Column | str, key: Column | str | None = None) -> tuple[Column, Column]:
    """Key and value of a record, split at its first tab; without a tab, ``key`` (or empty) and the line."""
    line = F.col(line) if isinstance(line, str) else line
    parts, has_tab = F.split(line, "\t", 2), F.instr(line, "\t") > 0
    default = F.lit("") if key is None else F.col(key) if isinstance(key, str) else key
    return F.when(has_tab, F.get(parts, F.lit(0))).otherwise(default), F.when(has_tab, F.get(parts, F.lit(1))).otherwise(line)


def csv_field(value: Column | str, index: int) -> Column:
    """Field ``index`` of a naive comma split, trimmed; negative counts from the end; missing is empty."""
    fields = F.split(value, ",")
    at = F.lit(index) if index >= 0 else F.size(fields) + index
    return F.coalesce(strip_ws(F.get(fields, at)), F.lit(""))


def first_fields(value: Column | str, n: int = 3) -> Column:
    return F.array_join(F.slice(F.split(value, ","), 1, n), ",")


def split_lines(text: Column | str) -> Column:
    """Lines of a text under any newline convention; a final newline adds no empty line."""
    return F.split(F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"\n\z", ""), "\n")


def numbered(df: DataFrame, coarse: Column, *order: str, name: str = "line_num", by: tuple[str, ...] = ()) -> DataFrame:
    """Contiguous 0-based numbers in the order of ``order``, in each ``by`` if given, without one global sort.

    ``coarse`` must never decrease along that order: rows are numbered within each of its
    values, plus the count of the group's rows under smaller values. A null counts as smallest.
    """
    marked = df.withColumn("_coarse", coarse)
    counts = marked.groupBy(*by, "_coarse").count()
    earlier = F.sum("count").over(Window.partitionBy(*by).orderBy("_coarse")) - F.col("count")
    before = counts.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate((*by, "_coarse"))], earlier.alias("_before"))
    inner = F.row_number().over(Window.partitionBy(*by, "_coarse").orderBy(*order))
    ranked = marked.withColumn("_inner", inner)
    same = reduce(and_, [ranked[c].eqNullSafe(before[f"_by{i}"]) for i, c in enumerate((*by, "_coarse"))])
    return ranked.join(before, same).withColumn(name, F.col("_before") + F.col("_inner") - 1).select(*df.columns, name)


def legacy_args(spec: str) -> tuple[str, list[str]]:
    """Name and arguments of ``name:args``: only the text up to a second colon counts, cut at blanks."""
    name, *rest = spec.split(":")
    return name, rest[0].split() if rest else []


def _bracket(pattern: str, at: int) -> tuple[str, int]:
    """A bracket expression that begins at ``at`` in Java syntax, and where it ends."""
    end = at + 1 + (pattern[at + 1 : at + 2] == "^")
    out, first = pattern[at:end], True
    while end < len(pattern) and (pattern[end] != "]" or first):
        named = next((n for n in POSIX_CLASSES if pattern.startswith(f"[:{n}:]", end)), None)
        if named:
            out += POSIX_CLASSES[named]
            end += len(named) + 4
        else:
            out += "\\" + pattern[end] if pattern[end] in "[]\\&^" else pattern[end]
            end += 1
        first = False
    if end >= len(pattern):
        raise ValueError(f"unmatched [ in pattern {pattern!r}")
    return out + "]", end + 1


_INTERVAL = re.compile(r"(\d*)(?:(,)(\d*))?")


def _interval(body: str, pattern: str) -> str | None:
    """A repetition such as ``2,5`` in Java syntax; None if it is none."""
    found = _INTERVAL.fullmatch(body)
    if not found or not (found[1] or found[2]):
        return None
    low, high = int(found[1] or 0), int(found[3]) if found[3] else None if found[2] else int(found[1])
    if high is not None and high < low:
        raise ValueError(f"repetition {{{body}}} in pattern {pattern!r} ends below its start")
    return f"{{{low},{'' if high is None else high}}}" if high != low else f"{{{low}}}"


def grep_pattern(pattern: str, extended: bool = False) -> str:
    """A POSIX basic or extended pattern in Java syntax.

    In a basic pattern ``+ ? | { } ( )`` stand for themselves unless a backslash precedes them;
    a star that begins a pattern or group, and an anchor elsewhere than at an end, do too. In an
    extended one a brace that opens no repetition stands for itself, ``{,n}`` counts from zero
    and repetitions may follow one another. What grep rejects (open groups and brackets, a
    trailing backslash, repetitions of nothing) is a ValueError.
    """
    out: list[str] = [""]  # finished text of each open group
    atom, at = "", 0  # what a repetition would repeat

    def fresh() -> bool:
        return not atom and (not out[-1] or out[-1].endswith("|"))

    while at < len(pattern):
        c, follow = pattern[at], pattern[at + 1 : at + 2]
        if c == "\\" and not follow:
            raise ValueError("trailing backslash in pattern")
        sign = c if extended else follow if c == "\\" and follow in "+?|{}()" else c if c == "*" else ""
        taken = 1 if extended or c == "*" else 2
        if c == "[":
            out[-1] += atom
            atom, at = _bracket(pattern, at)
            continue
        if sign in ("*", "+", "?") and sign:
            if atom:
                atom, at = f"(?:{atom}{sign})", at + taken
                continue
            if extended and fresh():
                raise ValueError(f"nothing to repeat before {sign} in pattern {pattern!r}")
        elif sign == "{":
            end = pattern.find("}" if extended else "\\}", at)
            repeat = _interval(pattern[at + taken : end], pattern) if end > 0 else None
            if repeat and atom:
                atom, at = f"(?:{atom}{repeat})", end + taken
                continue
            if not extended:
                raise ValueError(f"\\{{ without a repetition in pattern {pattern!r}")
        elif sign == "(":
            out[-1] += atom
            atom, at = "", at + taken
            out.append("")
            continue
        elif sign == ")":
            if len(out) == 1:
                raise ValueError(f"unmatched ) in pattern {pattern!r}")
            atom, at = f"({out.pop()}{atom})", at + taken
            continue
        elif sign == "|":
            out[-1] += atom + "|"
            atom, at = "", at + taken
            continue
        elif c == "^" and (extended or fresh()):
            out[-1] += atom + "^"
            atom, at = "", at + 1
            continue
        elif c == "$" and (extended or not follow or pattern[at + 1 : at + 3] in (r"\)", r"\|")):
            out[-1] += atom + "$"
            atom, at = "", at + 1
            continue
        out[-1] += atom
        if c == "\\":
            edges = {"<": f"(?<!{WORD})(?={WORD})", ">": f"(?<={WORD})(?!{WORD})", "b": f"(?:(?<!{WORD})(?={WORD})|(?<={WORD})(?!{WORD}))", "w": WORD, "W": WORD.replace("[", "[^", 1), "s": r"\s", "S": r"\S"}
            atom = edges.get(follow) or (f"\\{follow}" if not follow.isalpha() else follow)
            at += 2
        else:
            atom = c if c == "." or c.isalnum() or c.isspace() or ord(c) > 127 or c in "_-,:;=!@#%&'\"<>/~`" else f"\\{c}"
            at += 1
    if len(out) > 1:
        raise ValueError(f"unmatched ( in pattern {pattern!r}")
    return out[0] + atom


def many_ways(pattern: str, extended: bool = False) -> bool:
    """Whether the first match found may be shorter than the longest at its place: with groups or alternatives."""
    marks = "(|" if extended else (r"\(", r"\|")
    return any(m in pattern for m in marks)
