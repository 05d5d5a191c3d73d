"""Secret scans with multipart credential linking."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, table

ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Weak parts mean little alone: who signs in, where to, and a value that looks random.
IDENTIFIER = re.compile(r"""(?ai:\b(?:user(?:name|_?id)?|login|account|client_?id|key_?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""")
ENDPOINT = re.compile(r"""[a-z]{2,12}://[A-Za-z0-9@:._/-]{4,}""")
OPAQUE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")

#: Span kinds in the order in which equal starts are listed; the first three are the base kinds.
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
BASE_KINDS = KINDS[:3]
#: A linked part lies within so many code points of its complements.
SCOPE = 300

SPANS = "array<struct<kind:string,start:int,stop:int>>"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("access", *m.span()) for m in ACCESS.finditer(text)] + [("hex", *m.span()) for m in HEX.finditer(text)]
    if ":" in text or "=" in text:
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    return found


def weak_parts(text: str) -> list[tuple[str, int, int]]:
    """Identifiers, endpoints and opaque values (letters of both cases and a digit, or hex digits)."""
    found = []
    if ":" in text or "=" in text:
        found += [("identifier", *m.span()) for m in IDENTIFIER.finditer(text)]
        found += [("endpoint", *m.span()) for m in ENDPOINT.finditer(text)]
    for m in OPAQUE.finditer(text):
        value = m[0]
        if any(c.isdigit() for c in value) and (value.lower() != value and value.upper() != value or not value.strip("0123456789abcdef")):
            found.append(("secret", *m.span()))
    return found


def link_texts(text: str, weak: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """What of each endpoint is only its own address: all but user-info, where a secret may stand."""
    out = []
    for _, a, b in (w for w in weak if w[0] == "endpoint"):
        scheme = text.index("://", a) + 3
        host_end = text.find("/", scheme, b)
        sign = text.rfind("@", scheme, b if host_end < 0 else host_end)
        out += [("link", a, scheme), ("link", scheme if sign < 0 else sign, b)]
    return out


def near(spans: list[tuple[int, int]], start: int, stop: int, scope: int) -> bool:
    """Whether one of the spans, sorted and not overlapping, lies within ``scope`` of [start, stop)."""
    at = bisect_left(spans, start - scope, key=lambda s: s[1])
    return at < bisect_right(spans, stop + scope, key=lambda s: s[0])


def linked_spans(text: str | None, scope: int = SCOPE) -> list[tuple[str, int, int]]:
    """Base spans, and the weak parts whose complements stand within their scope.

    An interval join over the sorted spans of one text: an identifier needs a secret nearby, a
    secret an identifier, an endpoint both. Base spans complement too: an access key is an
    identifier, assigned and hex values are secrets. A weak part that overlaps a base span of
    the same role is that span; an identifier's own value and the path of a link are no secrets.
    """
    text = text or ""
    base, weak = base_spans(text), weak_parts(text)
    if weak:
        role = lambda spans, *of: merged(sorted((a, b) for k, a, b in spans if k in of))
        taken = {"identifier": role(base, "access"), "secret": role(base + weak + link_texts(text, weak), "assign", "hex", "identifier", "link"), "endpoint": []}
        weak = [(kind, a, b) for kind, a, b in weak if not near(taken[kind], a + 1, b - 1, 0)]
        identifiers, secrets = role(base + weak, "access", "identifier"), role(base + weak, "assign", "hex", "secret")
        for kind, a, b in weak:
            if (kind == "identifier" or near(identifiers, a, b, scope)) and (kind == "secret" or near(secrets, a, b, scope)):
                base.append((kind, a, b))
    return sorted(base, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def secret_spans(text: Column | str, scope: int = SCOPE) -> Column:
    """Column of spans (kind, start, stop), code points, of every whole text.

    Stop is exclusive; order is by start, then kind as in ``KINDS``. Every row stands alone,
    so ids, repeated rows, clashing columns and empty tables don't matter. A null or empty text has
    no spans; a text of any length is read whole, as one value.
    """

    @F.arrow_udf(SPANS)
    def spans(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))
        return pa.array([[{"kind": k, "start": a, "stop": b} for k, a, b in linked_spans(t.as_py(), scope)] for t in texts], kind)

    return spans(text)


def masked(text: Column | str, scope: int = SCOPE, mark: str = "[SECRET]") -> Column:
    """Each text with every span, overlapping ones together, replaced by ``mark``; null stays null."""

    @F.arrow_udf("string")
    def mask(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            t = t.as_py()
            spans = merged(sorted((a, b) for _, a, b in linked_spans(t, scope)))
            if spans:
                t = t[: spans[0][0]] + "".join(mark + t[b:c] for (_, b), c in zip(spans, [a for a, _ in spans[1:]] + [len(t)]))
            out.append(t)
        return pa.array(out, pa.string())

    return mask(text)


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), secret_spans("text").alias("found"))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *[count(k) for k in BASE_KINDS], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))
