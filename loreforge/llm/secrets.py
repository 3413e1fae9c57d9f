"""Secret scans with multipart credential linking.

Each kind of finding is one of three parts of a credential: an access identifier,
a secret or an endpoint.  Strong findings (``assign``, ``access``, ``hex``) are
reported by themselves.  Weak candidates (a user name, a random-looking token, an
address) are too common for that: they are joined as intervals within their scope, a
run of lines without a blank one, and reported only if candidates of other parts
lie within ``REACH`` characters of each other so that a secret meets an identifier
or an endpoint.

The interval join is a sweep over one text's candidates in order of place; no pair
of them is ever listed, so its cost grows with their number.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreforge.llm.common import bounded_batches, slices, table, text_or_empty

REACH = 200
#: Kinds in the order that breaks ties of places, with the part of a credential that each is.
KINDS = {"assign": "secret", "access": "identifier", "hex": "secret", "user": "identifier", "blob": "secret", "endpoint": "endpoint"}
BASE = ("assign", "access", "hex")
_ORDER = {k: i for i, k in enumerate(KINDS)}
_ASCII = re.ASCII | re.IGNORECASE
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", _ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_USER = re.compile(r"""(?:user(?:name)?|login|client_?id|account)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@+-]{3,})""", _ASCII)
_ENDPOINT = re.compile(r"(?:https?|ftp|ssh|s3|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?)://[A-Za-z0-9.-]+(?::[0-9]{1,5})?(?:/[A-Za-z0-9._~/%+-]*)?", _ASCII)
_BLOB = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
_BLANK = re.compile(r"\n[\x20\t\r]*\n")
LEAST_BITS = 3.5


def entropy(token: str) -> float:
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in Counter(token).values())


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The findings that stand by themselves, leftmost and non-overlapping within each kind."""
    out = []
    if ":" in text or "=" in text:
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    return out + [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]


def weak_candidates(text: str, strong: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """User names, addresses and random-looking tokens outside the strong findings."""
    out = []
    if ":" in text or "=" in text:
        out += [("user", m.start(1), m.end(1)) for m in _USER.finditer(text)]
        if "://" in text:
            out += [("endpoint", m.start(), m.end()) for m in _ENDPOINT.finditer(text)]
    taken = Spans([*strong, *out])
    for m in _BLOB.finditer(text):
        token = m[0]
        if any(c.isdigit() for c in token) and any(c.isalpha() for c in token) and entropy(token) >= LEAST_BITS and not taken.meet(m.start(), m.end()):
            out.append(("blob", m.start(), m.end()))
    if strong:
        held = Spans(strong)
        out = [s for s in out if not held.meet(s[1], s[2])]
    return out


class Spans:
    """Intervals, merged, to ask whether any of them meets another."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        self.starts, self.ends = [], []
        for _, a, b in sorted(spans, key=lambda s: s[1]):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meet(self, a: int, b: int) -> bool:
        i = bisect_left(self.starts, b) - 1
        return i >= 0 and self.ends[i] > a


def linked(text: str, strong: list[tuple[str, int, int]], weak: list[tuple[str, int, int]], reach: int = REACH) -> list[tuple[str, int, int]]:
    """The weak candidates whose complementary part lies within ``reach`` in the same scope.

    For a secret that is an identifier or an endpoint, for those it is a secret.
    """
    if not weak:
        return []
    edges = [m.start() for m in _BLANK.finditer(text)]
    by_part: dict[tuple[int, str], list[tuple[int, int]]] = {}
    for kind, a, b in [*strong, *weak]:
        part = "secret" if KINDS[kind] == "secret" else "other"
        by_part.setdefault((bisect_left(edges, b), part), []).append((a, b))
    near = {at: Spans([("", max(0, a - reach), b + reach) for a, b in spans]) for at, spans in by_part.items()}
    out = []
    for kind, a, b in weak:
        other = near.get((bisect_left(edges, b), "other" if KINDS[kind] == "secret" else "secret"))
        if other is not None and other.meet(a, b):
            out.append((kind, a, b))
    return out


def find(text: str, reach: int = REACH) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans and all spans of a text, each in order of place, then of kind."""
    place = lambda s: (s[1], _ORDER[s[0]], s[2])
    strong = base_spans(text)
    return sorted(strong, key=place), sorted([*strong, *linked(text, strong, weak_candidates(text, strong), reach)], key=place)


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(df: DataFrame, keep: list[str], text: str = "text", *, reach: int = REACH) -> DataFrame:
    """The ``keep`` columns, n_assign, n_access, n_hex, base_sha256, spans and n_linked (weak candidates reported) of every row.

    A null text is an empty one, without findings.  Places count code points.  Rows
    are independent, so repeated rows, ties and other columns change nothing; no
    rows: no rows.
    """
    n = len(keep)
    src = bounded_batches(df).select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keep)], text_or_empty(text).alias("body"))
    schema = ", ".join([*[f"k{i} {df.schema[k].dataType.simpleString()}" for i, k in enumerate(keep)], "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_linked bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = [find(body, reach) for body in part.column("body").to_pylist()]
                counts = [Counter(k for k, _, _ in base) for base, _ in found]
                made = [pa.array([c[k] for c in counts], pa.int64()) for k in BASE]
                made += [pa.array([hashlib.sha256(listed(base).encode()).hexdigest() for base, _ in found], pa.string()), pa.array([listed(all_) for _, all_ in found], pa.string()), pa.array([len(a) - len(b) for b, a in found], pa.int64())]
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *made], names=[*[f"k{i}" for i in range(n)], "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked"])

    out = src.mapInArrow(run, schema)
    return out.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keep)], "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked")


def op5_credential_links(spark, sf_dir):
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked of every document."""
    return scan(table(spark, sf_dir, "documents"), ["doc_id"])
