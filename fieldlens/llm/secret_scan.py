"""Secret scan: fixed patterns, and an assignment-aware lexer that judges literals by the names they are given to.

The lexer reads name-literal pairs of source code (``name = "literal"``, ``name := 'x'``, ``"name": "x"``,
``name="x"`` in markup, ``name: str = "x"`` with a type) and of configuration lines (``NAME=value``, ``name: value``), follows constants
(``client_secret = k`` with ``k = "abc..."`` before or after it, through any number of names) and scores a literal by how sensitive its target names are
and how unlike prose it looks. A literal may have a prefix, escapes, three quotes or round brackets, stand on the next line or be put together of
several, each of which is a span; keys in brackets (``env["NAME"] = "x"``) are names and references. Everything happens inside one row, so the scan is a map without a shuffle.

Defined results: a null text is empty; an empty text has no spans; offsets are code points of the whole text. Every row counts alone, so repeated rows
get equal spans; equal literals are found wherever they stand; time grows with the length of a text. Extra columns are left out of ``find_secrets`` and kept by ``mask_secrets``.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fieldlens.llm.base import arrow_map, text_of

# fixed values: the base patterns and their least lengths
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "lexed")

_NAME = r"[A-Za-z_$][A-Za-z0-9_$]*(?:[.-][A-Za-z0-9_$]+)*"
#: a declared type: ``: str``, ``?: string | null``, ``: Option<String>``, ``: &'static str``; then ``=`` and a literal, or a spaced ``=``
_TYPE = (rf"""\??+:[ \t]*+(?:&(?:'[a-z_]++[ \t]++)?+(?:mut[ \t]++)?+)?+{_NAME}(?:\[[A-Za-z0-9_., \t|]*+\]|<[A-Za-z0-9_., \t|<]*+>++)*+"""
         rf"""(?:[ \t]*+\|[ \t]*+{_NAME})*+(?:[ \t]*+=(?=[ \t]*+["'`])|[ \t]++=(?=[ \t]))""")
#: a string literal: prefixed, triple-quoted over lines, escapes inside; an open one is none
_LITERAL = (r"""[A-Za-z]{0,2}+(?:\"{3}(?P<tdq>(?:[^"\\]|\\[\s\S]|"(?!""))*+)\"{3}|'{3}(?P<tsq>(?:[^'\\]|\\[\s\S]|'(?!''))*+)'{3}"""
            r"""|"(?P<dq>(?:[^"\\\n]|\\.)*+)"|'(?P<sq>(?:[^'\\\n]|\\.)*+)'|`(?P<bq>(?:[^`\\\n]|\\.)*+)`)""")
QUOTED = ("tdq", "tsq", "dq", "sq", "bq")
#: name (a key in brackets too), a declared type if any, operator; then a literal, also in round brackets or on the next line, a reference to
#: another name or key, or the bare rest of a configuration line
PAIR = re.compile(
    rf"""(?P<quote>["']?)(?P<name>{_NAME})(?P=quote)(?:[ \t]*+\])?+[ \t]*+(?:{_TYPE}|(?::=|=>|[:=]))[ \t]*+"""
    rf"""(?:(?:\\?\r?\n[ \t]*+|\([ \t\r\n]*+)*+{_LITERAL}|(?:{_NAME}(?P<key>\[)["'])?+(?P<ref>{_NAME})(?(key)["']\])(?=[ \t]*+(?:[;,)\n]|$))|(?P<bare>[^\s"'`,;]+))"""
    # a long name without an operator is passed over as one, so that none of its ends is tried again
    rf"""|(?=[A-Za-z0-9_$.-]{{24}}){_NAME}""", re.A,
)
#: a literal that goes on: added, joined or written next to the one before it
MORE = re.compile(rf"""[ \t]*+(?:(?:\+|\.\.?|&|\|\|)[ \t\r\n]*+|\\\r?\n[ \t]*+|\r?\n[ \t]*+(?:\+|\.)[ \t]*+)?+{_LITERAL}""", re.A)
#: lower-case words with a number at most, joined by signs: the name of a thing rather than a key
_WORDY = re.compile(r"[a-z]{2,}+(?:[_.:/-]+[a-z]{2,}+)*+(?:[_.:/-]+v?[0-9]{1,4})?+|[a-z]{2,}+[0-9]{0,2}+")
#: words of a name and what each says about the value
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9,
    "credentials": 0.9, "bearer": 0.8, "auth": 0.5, "authorization": 0.6, "private": 0.4, "access": 0.3, "signing": 0.4, "client": 0.1,
    "api": 0.4, "key": 0.5, "pass": 0.6, "salt": 0.4, "session": 0.3, "webhook": 0.4,
}
THRESHOLD = 1.2
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def name_score(name: str) -> float:
    """Sum of what the words of a name say, 1 at most."""
    return min(1.0, sum(SENSITIVE.get(w.lower(), 0.0) for w in _PARTS.findall(name)))


def literal_score(value: str) -> float:
    """0 to 1: length, mixed character classes and entropy; prose and placeholders score low."""
    if len(value) < 6 or any(c.isspace() for c in value) or len(set(value)) < 4:
        return 0.0
    entropy = -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())
    classes = any(c.isdigit() for c in value) + any(c.islower() for c in value) + any(c.isupper() for c in value) + any(not c.isalnum() for c in value)
    score = min(1.0, entropy / 4.5) * 0.6 + 0.2 * (classes >= 2) + 0.2 * (len(value) >= 12)
    return min(score, 0.2) if _WORDY.fullmatch(value) else score


def _literal(text: str, m: re.Match) -> tuple[tuple[tuple[int, int], ...], str, int] | None:
    """Spans of the pieces of a quoted literal, its whole value, and where it ends."""
    group = next((g for g in QUOTED if m[g] is not None), None)
    if group is None:
        return None
    spans, values, end = [m.span(group)], [m[group]], m.end()
    while (m := MORE.match(text, end)) is not None:
        group = next(g for g in QUOTED if m[g] is not None)
        spans.append(m.span(group))
        values.append(m[group])
        end = m.end()
    return tuple(spans), "".join(values), end


def lexed(text: str) -> list[tuple[int, int]]:
    """Spans of literals whose target names, directly or through constants, are sensitive."""
    pairs, constants, waiting = [], {}, {}
    first = {}  # of every name the first literal, for references that come before it
    at = 0
    while (m := PAIR.search(text, at)) is not None:
        name, quoted, at = m["name"], _literal(text, m), m.end()
        if name is None:
            continue
        if quoted is not None:
            constants[name], at = quoted[:2], quoted[2]
            pairs.append((name, constants[name]))
        elif m["bare"] is not None:
            constants[name] = ((m.span("bare"),), m["bare"])
            pairs.append((name, constants[name]))
        elif m["ref"] in constants:
            constants[name] = constants[m["ref"]]
            pairs.append((name, constants[name]))
        else:  # a constant that follows, or a bare word of a configuration line
            if m["key"] is None:
                pairs.append((name, ((m.span("ref"),), m["ref"])))
            waiting.setdefault(m["ref"], []).append(name)
        if name in constants:
            first.setdefault(name, constants[name])
    ready = [ref for ref in waiting if ref in first]
    while ready:
        ref = ready.pop()
        for name in waiting.pop(ref, ()):
            pairs.append((name, first[ref]))
            if name not in first:
                first[name] = first[ref]
                ready.append(name)
    found = set()
    for name, (spans, value) in pairs:
        score = name_score(name)
        if score >= 0.5 and score + literal_score(value) >= THRESHOLD:
            found.update(s for s in spans if s[0] < s[1])
    return sorted(found)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the three base patterns, in order of start, then of kind."""
    found = []
    if ":" in text or "=" in text:
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def scan(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans: a lexed literal is added unless a base span holds it."""
    base = base_spans(text)
    more = []
    if ":" in text or "=" in text:
        starts, reach = [b for _, b, _ in base], list(accumulate((f for _, _, f in base), max))
        for s, e in lexed(text):
            before = bisect_right(starts, s)
            if not before or reach[before - 1] < e:
                more.append(("lexed", s, e))
    return base, sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0])))


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def masked(text: str, spans: list[tuple[str, int, int]], mask: str = "[secret]") -> str:
    """The text with every covered stretch replaced by ``mask``; overlapping spans give one mask."""
    out, at = [], 0
    for _, start, end in sorted(spans, key=lambda s: s[1:]):
        if end > at:
            if start >= at:
                out += [text[at:start], mask]
            at = end
    return "".join([*out, text[at:]])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        scans = [scan(t) for t in text_of(batch.column(1))]
        count = lambda kind: pa.array([sum(s[0] == kind for s in b) for b, _ in scans], pa.int64())
        yield pa.RecordBatch.from_arrays([
            batch.column(0), count("assign"), count("access"), count("hex"),
            pa.array([hashlib.sha256(listed(b).encode()).hexdigest() for b, _ in scans], pa.string()), pa.array([listed(a) for _, a in scans], pa.string()),
        ], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts of the base kinds, their digest, and all spans as ``kind:start:end``."""
    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).transform(
        arrow_map,
        _rows, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def mask_secrets(docs: DataFrame, text: str = "text", mask: str = "[secret]") -> DataFrame:
    """``docs`` with every found span masked in ``text``; other columns and null texts stay as they are."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            new = [None if t is None else masked(t, s, mask) if (s := scan(t)[1]) else t for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    return docs.transform(arrow_map, rows, docs.schema)
