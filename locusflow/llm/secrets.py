"""Secret scans: patterns, and sliding-window entropy per character class over candidate strings.

Candidates are maximal runs of `[A-Za-z0-9+/_=-]` of `MIN_CANDIDATE` or more characters. A window of
`WINDOW` characters slides over each; its Shannon entropy comes from counts changed by one character
in and one out. A window is flagged when its entropy reaches the limit of its class (hexadecimal, or
mixed: letters of both cases or letters and digits), and adjoining flagged windows make one span.
Candidates of the allow list (identifiers in UUID form, digits only, letters of one case or in CamelCase
words, words joined by - _ / =) give none, and a span lying within a pattern's span isn't repeated.

Cases: a null or empty text has no spans; offsets are code points, ends exclusive; spans are ordered
by start, then kind as in `KINDS`; repeated rows give repeated results; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .session import bounded_batches, documents
from .textblocks import blocks, char_starts, segments

#: The patterns of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24

KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_mixed")
_ORDER = {kind: i for i, kind in enumerate(KINDS)}
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

MIN_CANDIDATE = 20
WINDOW = 20
LIMITS = {"entropy_hex": 3.1, "entropy_mixed": 3.6}
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
SEPARATOR = re.compile(r"[-_/=+]+")
PLAIN_PART = re.compile(r"[A-Z]?[a-z]*|[A-Z]+|[0-9]{1,4}")
CAMEL_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
VOWEL = re.compile(r"[aeiouyAEIOUY]")


def words_in_case(s: str) -> bool:
    """Whether letters of both cases split into CamelCase words: 3.5 letters or more on average, at most one single, vowels in those of three or more (but for one, such as Http, where words are of 4.5 letters or more)."""
    parts = CAMEL_PART.findall(s)
    return 2 * len(s) >= 7 * len(parts) and sum(len(p) == 1 for p in parts) <= 1 and sum(not VOWEL.search(p) for p in parts if len(p) > 2 and not p.isupper()) <= (2 * len(s) >= 9 * len(parts))


def allowed(s: str) -> bool:
    """A UUID, digits and separators only, letters of one case or in CamelCase words, or words and short numbers joined by separators."""
    if UUID.fullmatch(s):
        return True
    if s.isalpha():
        return s.islower() or s.isupper() or words_in_case(s)
    parts = SEPARATOR.split(s)
    return all(p.isdigit() or not p for p in parts) or all(PLAIN_PART.fullmatch(p) for p in parts)


_CANDIDATE = np.zeros(256, dtype=bool)
_CANDIDATE[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")] = True
_CLOG = [0.0, *(c * math.log2(c) for c in range(1, WINDOW + 2))]  # one more: a character comes in before one goes
Span = tuple[str, int, int]


def entropy_spans(s: str, window: int = WINDOW) -> list[Span]:
    """Merged runs of flagged windows in one candidate string, as (kind, start, end)."""
    if len(s) < window or allowed(s):
        return []
    out: list[Span] = []
    counts: dict[str, int] = {}
    total = 0.0  # the sum of c * log2(c)
    lower = upper = digit = hexa = 0
    base = math.log2(window)
    for i, c in enumerate(s):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += _CLOG[n + 1] - _CLOG[n]
        lower += "a" <= c <= "z"
        upper += "A" <= c <= "Z"
        digit += "0" <= c <= "9"
        hexa += c in "0123456789abcdefABCDEF"
        if i >= window:
            d = s[i - window]
            n = counts[d]
            counts[d] = n - 1
            total += _CLOG[n - 1] - _CLOG[n]
            lower -= "a" <= d <= "z"
            upper -= "A" <= d <= "Z"
            digit -= "0" <= d <= "9"
            hexa -= d in "0123456789abcdefABCDEF"
        if i + 1 < window:
            continue
        if hexa == window:
            kind = "entropy_hex"
            mixed = digit > 1 and lower + upper > 1
        else:
            kind = "entropy_mixed"
            mixed = (digit > 1) + (lower > 1) + (upper > 1) >= 2 and (digit > 1 or (lower > 3 and upper > 3))
        if mixed and base - total / window >= LIMITS[kind]:
            start, end = i + 1 - window, i + 1
            if out and out[-1][2] >= start:
                out[-1] = (out[-1][0], out[-1][1], end)
            else:
                out.append((kind, start, end))
    return out


def candidate_spans(s: str) -> list[Span]:
    """Pattern spans inside one candidate string, and the entropy spans outside those."""
    base = [("access", m.start(), m.end()) for m in ACCESS.finditer(s) if m.end() - m.start() >= ACCESS_LEAST]
    base += [("hex", m.start(), m.end()) for m in HEX.finditer(s) if m.end() - m.start() >= HEX_LEAST]
    return base + entropy_spans(s)


def assign_spans(text: str) -> list[Span]:
    low = text.lower()
    if not any(w in low for w in WORDS):
        return []
    return [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]


def ordered(spans: list[Span]) -> list[Span]:
    """By start, then kind; an entropy span within a pattern's span goes."""
    base = [x for x in spans if _ORDER[x[0]] < 3]
    rest = [x for x in spans if _ORDER[x[0]] >= 3 and not any(b[1] <= x[1] and x[2] <= b[2] for b in base)]
    return sorted(base + rest, key=lambda x: (x[1], _ORDER[x[0]], x[2]))


def scan(texts: pa.Array) -> Iterator[tuple[int, list[Span]]]:
    """(row, its spans in order) for the rows that have any, in row order."""
    for block in blocks(texts):
        found: dict[int, list[Span]] = {}
        starts, ends, rows = segments(_CANDIDATE[block.array], block.offsets)
        long = np.flatnonzero(ends - starts >= MIN_CANDIDATE)
        if len(long):
            points = np.concatenate([[0], np.cumsum(char_starts(block.array))])
            for s, e, r in zip(starts[long].tolist(), ends[long].tolist(), rows[long].tolist(), strict=True):
                at = int(points[s] - points[block.offsets[r]])
                for kind, i, j in candidate_spans(block.data[s:e].decode()):
                    found.setdefault(r, []).append((kind, at + i, at + j))
        low = block.data.lower()
        if any(w.encode() in low for w in WORDS):
            for r in range(len(block)):
                if spans := assign_spans(block.row(r).decode()):
                    found.setdefault(r, []).extend(spans)
        for r in sorted(found):
            yield block.first_row + r, ordered(found[r])


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan_secrets(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, spans array of (kind, start, end)) of every row; a narrow map without a shuffle."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for row, spans in scan(batch.column("t")):
                out[row] = [{"kind": k, "start": s, "end": e} for k, s, e in spans]
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(out, pa.list_(item))], ["k", "spans"])

    frame = docs.selectExpr(f"`{key}` AS k", f"cast(`{text}` AS string) AS t")
    return frame.mapInArrow(run, f"k {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>").withColumnRenamed("k", key)


def redact(docs: DataFrame, *, text: str = "text", mark: str = "[REDACTED]") -> DataFrame:
    """The same rows and columns with every span replaced by a mark; other values stay as they are."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            column = batch.column(at)
            changed = {row: _cover(column[row].as_py(), spans, mark) for row, spans in scan(column)}
            if changed:
                column = pa.array([changed.get(i, x) for i, x in enumerate(column.to_pylist())], column.type)
                batch = batch.set_column(at, batch.schema.field(at), column)
            yield batch

    return docs.mapInArrow(run, docs.schema)


def _cover(text: str, spans: list[Span], mark: str) -> str:
    out, at = [], 0
    for _, s, e in sorted(spans, key=lambda x: (x[1], x[2])):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    bounded_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    empty = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            counts = np.zeros((3, n), dtype=np.int64)
            sha, spans = [empty] * n, [""] * n
            for row, found in scan(batch.column("t")):
                base = [x for x in found if _ORDER[x[0]] < 3]
                for x in base:
                    counts[_ORDER[x[0]], row] += 1
                sha[row] = hashlib.sha256(joined(base).encode()).hexdigest()
                spans[row] = joined(found)
            cols = [batch.column("k"), *(pa.array(c) for c in counts), pa.array(sha, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["k", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    out = docs.selectExpr("doc_id AS k", "text AS t").mapInArrow(run, f"k {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")
    return out.withColumnRenamed("k", "doc_id")
