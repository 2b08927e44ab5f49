"""Secret scans with multipart credential linking.

Strong findings stand alone: assignments of a value to a secret's name, access identifiers and long
hexadecimal strings.  Weak findings (a login name, an opaque token, an endpoint) mean nothing alone:
they are reported only when complementary parts co-occur, found by an interval join of access
identifiers, secrets and endpoints within a scope (a gap of at most ``scope`` code points):

* ``login``: an access identifier, complete with any secret (assign, hex, opaque) in its scope;
* ``opaque``: a secret, complete with any access identifier (access, login) in its scope;
* ``endpoint``: complete with an access identifier and a secret, both in its scope.

Cases: a null or empty text has no findings; texts are scanned whole; spans are code points, end
exclusive; equal spans of different kinds are all reported; repeated rows give equal results; an
empty table gives no rows; other columns are not read (``redact_documents`` keeps them).
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradelens.llm.common import map_batches, texts_of

SCOPE = 200

# The base patterns, in the order of the kinds.  re.ASCII keeps "either case" to A-Z.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")

# Weak parts.
LOGIN = re.compile(r"""\b(?:user(?:name|_id)?|login|account|client_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@_.+-]{3,})""",
                   re.ASCII | re.IGNORECASE)
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{32,}={0,2}")
ENDPOINT = re.compile(r"""\b(?:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s"'<>]+""")

KINDS = ("assign", "access", "hex", "login", "opaque", "endpoint")
BASE = KINDS[:3]
Span = tuple[int, int, int]  # start, kind's place in KINDS, end


def base_spans(text: str) -> list[Span]:
    """Strong findings, leftmost and non-overlapping in each kind, in the order of their starts."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _mixed(s: str) -> bool:
    return any(c.isdigit() for c in s) and any(c.isupper() for c in s) and any(c.islower() for c in s)


def weak_spans(text: str) -> list[Span]:
    """Candidates of the weak kinds, before linking."""
    found = [(m.start(), 3, m.end()) for m in LOGIN.finditer(text)]
    found += [(m.start(), 4, m.end()) for m in OPAQUE.finditer(text) if _mixed(m.group())]
    found += [(m.start(), 5, m.end()) for m in ENDPOINT.finditer(text)]
    return sorted(found)


class _Parts:
    """Intervals of one role, for the question whether one lies within a scope of a span."""

    def __init__(self, spans: list[Span]):
        self.spans = sorted(spans)
        self.starts = [s[0] for s in self.spans]
        self.reach, far = [], -1  # the furthest end among the spans up to here
        for s in self.spans:
            far = max(far, s[2])
            self.reach.append(far)

    def near(self, span: Span, scope: int) -> bool:
        """A part that starts at most ``scope`` behind the span's end and ends at most ``scope`` before
        its start, the span itself not counted."""
        last = bisect_right(self.starts, span[2] + scope)
        own = bisect_left(self.spans, span)
        if own < len(self.spans) and self.spans[own] == span:
            return (own > 0 and self.reach[own - 1] >= span[0] - scope) or last > own + 1
        return last > 0 and self.reach[last - 1] >= span[0] - scope


def linked_spans(base: list[Span], weak: list[Span], scope: int = SCOPE) -> list[Span]:
    """The weak candidates whose complementary parts co-occur."""
    identifiers = _Parts([s for s in base + weak if KINDS[s[1]] in ("access", "login")])
    secrets = _Parts([s for s in base + weak if KINDS[s[1]] in ("assign", "hex", "opaque")])
    need = {3: (secrets,), 4: (identifiers,), 5: (identifiers, secrets)}
    return [s for s in weak if all(parts.near(s, scope) for parts in need[s[1]])]


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_documents(docs: DataFrame, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, n_weak, base_sha256, spans``: all findings of each document.

    ``spans`` lists ``kind:start:end`` by start, then by kind in the order of ``KINDS``.
    """
    def fn(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "n_weak", "base_sha256", "spans")}
        for text in batch.column(1).to_pylist():
            base = base_spans(text)
            linked = linked_spans(base, weak_spans(text), scope)
            for place, name in enumerate(("n_assign", "n_access", "n_hex")):
                out[name].append(sum(s[1] == place for s in base))
            out["n_weak"].append(len(linked))
            out["base_sha256"].append(hashlib.sha256(listed(base).encode()).hexdigest())
            out["spans"].append(listed(sorted(base + linked)))
        return {"doc_id": batch.column(0), **out}

    return map_batches(texts_of(docs, id_col, text_col), fn,
                       "doc_id long, n_assign long, n_access long, n_hex long, n_weak long, base_sha256 string, spans string")


def redacted(text: str, scope: int = SCOPE) -> str:
    """The text with every finding replaced by ``[kind]``; overlapping findings become one, named after
    the first."""
    base = base_spans(text)
    out, at = [], 0
    merged: list[list[int]] = []
    for a, k, b in sorted(base + linked_spans(base, weak_spans(text), scope)):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([a, k, b])
    for a, k, b in merged:
        out += [text[at:a], f"[{KINDS[k]}]"]
        at = b
    return "".join([*out, text[at:]])


def redact_documents(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The documents with their findings redacted and ``n_chars`` counted anew; all rows and columns stay.

    A null text stays null.  Only ``text`` and ``n_chars`` change.
    """
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if t is None else redacted(t, scope) for t in batch.column(place).to_pylist()]
            columns = list(batch.columns)
            columns[place] = pa.array(texts, batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op10(docs: DataFrame) -> DataFrame:
    return scan_documents(docs)
