"""Secret scans with multipart credential linking.

Strong secrets (assignments, access identifiers, long hexadecimal strings) are reported as they stand. Weak candidates -
values under names such as client_id, strings of high entropy, user and password of an address, endpoints - are kept
back: inside a scope (a paragraph, of any length) identifiers, secrets and endpoints are interval-joined, and a weak
candidate is reported only where complementary parts co-occur: a secret with an identifier, and an endpoint with both.
Parts may stand inside one another, as a key in an address does. With ``reach``, two parts also have to stand at most so
many code points apart. The join asks an index of each scope's intervals, so many parts cost n log n, never all pairs.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._common import id_and_text, read_table

#: Kinds in the order in which equal starts are listed; the first three are strong.
KINDS = ("assign", "access", "hex", "linked_id", "linked_secret", "linked_endpoint")
BASE = 3

# The base patterns (fixed values).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+", re.ASCII)
HEX = re.compile(r"[0-9a-f]{32,}", re.ASCII)  # a run of 32 or more: the same matches as a shorter run's pattern keeps
ASSIGN_HINTS = ("passw", "secret", "token", "apikey", "api_key")
MIN_ASSIGN, MIN_ACCESS = 8, 16

# Weak parts.
IDENTIFIER = re.compile(r"""\b(?:access_?key_?id|client_?id|account_?(?:id|name)|user_?(?:id|name)|login|uid)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""", re.ASCII | re.IGNORECASE)
IDENTIFIER_HINTS = ("key_id", "keyid", "client", "account", "user", "login", "uid")
ENDPOINT = re.compile(r"""(?:https?|wss?|ftps?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s"'<>]+|\b(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]+(?::\d+)?""", re.ASCII | re.IGNORECASE)
ENDPOINT_HINTS = ("://", "host", "endpoint", "server")
# User and password, and a parameter's value, inside an address; user and password stand where they do by their meaning.
# Neither has an upper length: the classes leave out what begins an address, so a text is searched once.
USERINFO = re.compile(r"://([^\s:/?#@\"'<>]++):([^\s/?#@\"'<>]{6,}+)@", re.ASCII)
PARAMETER = re.compile(r"[?&;#][A-Za-z0-9_.-]+=([A-Za-z0-9+/_.~-]{16,}={0,2})", re.ASCII)
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{16,}={0,2}(?![A-Za-z0-9+/_=-])", re.ASCII)
PARAGRAPH = re.compile(r"\n[\t ]*\n")
MIN_ENTROPY = 3.5

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, found array<struct<kind:string,start:int,end:int>>"


def _entropy(s: str) -> float:
    return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values())


def _weak_secret(s: str) -> bool:
    """Mixed letters and digits of high entropy: no word, number or path."""
    return any(c.isdigit() for c in s) and any(c.isupper() for c in s) and any(c.islower() for c in s) and s.count("/") <= 3 and _entropy(s) >= MIN_ENTROPY


def base_spans(text: str, lower: str | None = None) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the strong secrets: leftmost, not overlapping within a kind."""
    lower = text.lower() if lower is None else lower
    found = []
    if any(h in lower for h in ASSIGN_HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


class _Index:
    """Intervals by scope, asked whether one stands in another's scope, within reach of it if there is one."""

    def __init__(self, parts: list[tuple[int, int]], scope: Callable[[int], int]):
        self.scope = scope
        self.starts: dict[int, list[int]] = {}
        self.ends: dict[int, list[int]] = {}  # the largest end so far
        for a, b in sorted(parts):
            at = scope(a)
            ends = self.ends.setdefault(at, [])
            self.starts.setdefault(at, []).append(a)
            ends.append(max(b, ends[-1]) if ends else b)

    def near(self, part: tuple[int, int], reach: int | None) -> bool:
        """Of those that start at most reach after the part's end, does one end at most reach before its start?"""
        at = self.scope(part[0])
        if reach is None or at not in self.starts:
            return at in self.starts
        i = bisect_right(self.starts[at], part[1] + reach)
        return i > 0 and self.ends[at][i - 1] >= part[0] - reach


def _covered(spans: list[tuple[int, int]], within: list[tuple[int, int]]) -> set[tuple[int, int]]:
    """Those spans that overlap one of within; both sorted."""
    out, reach_, ends = set(), 0, []
    starts = [a for a, _ in within]
    for _, b in within:
        reach_ = max(reach_, b)
        ends.append(reach_)
    for a, b in spans:
        i = bisect_left(starts, b)
        if i and ends[i - 1] > a:
            out.add((a, b))
    return out


def parts_of(text: str, base: list[tuple[int, int, int]], lower: str) -> tuple[set, set, set]:
    """(identifiers, secrets, endpoints) as spans: the weak candidates. One span has one role: an identifier is no secret,
    and what a strong secret overlaps is neither."""
    ids = {m.span(1) for m in IDENTIFIER.finditer(text)} if any(h in lower for h in IDENTIFIER_HINTS) else set()
    ends = {m.span() for m in ENDPOINT.finditer(text)} if any(h in lower for h in ENDPOINT_HINTS) else set()
    if not (ids or ends or any(k == 1 for _, k, _ in base)):
        return set(), set(), set()
    secrets = {m.span() for m in CANDIDATE.finditer(text) if _weak_secret(m[0])}
    if ends:
        secrets |= {m.span(1) for m in PARAMETER.finditer(text) if _weak_secret(m[1])}
        named = list(USERINFO.finditer(text))
        ids |= {m.span(1) for m in named}
        secrets = (secrets - _covered(sorted(secrets), sorted({m.span(2) for m in named}))) | {m.span(2) for m in named}
    strong = sorted((a, b) for a, _, b in base)
    ids -= _covered(sorted(ids), strong)
    return ids, secrets - _covered(sorted(secrets), sorted([*strong, *ids])), ends


def linked_spans(text: str, base: list[tuple[int, int, int]], lower: str | None = None, reach: int | None = None) -> list[tuple[int, int, int]]:
    """Weak candidates with complementary parts in their scope, as (start, kind number, end)."""
    ids, secrets, ends = parts_of(text, base, text.lower() if lower is None else lower)
    all_ids = ids | {(a, b) for a, k, b in base if k == 1}
    all_secrets = secrets | {(a, b) for a, k, b in base if k in (0, 2)}
    if not all_ids or not all_secrets:
        return []
    borders = [m.start() for m in PARAGRAPH.finditer(text)]
    scope = lambda at: bisect_right(borders, at)
    with_id, with_secret = _Index(list(all_ids), scope), _Index(list(all_secrets), scope)
    out = [(a, 4, b) for a, b in secrets if with_id.near((a, b), reach)]
    out += [(a, 3, b) for a, b in ids if with_secret.near((a, b), reach)]
    out += [(a, 5, b) for a, b in ends if with_id.near((a, b), reach) and with_secret.near((a, b), reach)]
    return sorted(out)


def spans_of(text: str, reach: int | None = None) -> list[tuple[int, int, int]]:
    """All spans, (start, kind number, end), sorted; starts and ends count code points."""
    lower = text.lower()
    base = base_spans(text, lower)
    return sorted(base + linked_spans(text, base, lower, reach))


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_secrets(docs: DataFrame, reach: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: counts of the strong kinds, a digest of their spans, all spans as text and as an array.

    Null and empty texts have no spans (their digest is that of the empty text); rows without an id and repeated rows are
    kept; an empty table gives an empty result; other columns are ignored, whatever their names. Texts are read whole.
    """

    def run(batches):
        struct = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            counts, digests, joined, found = [[], [], []], [], [], []
            for text in batch.column(1).to_pylist():
                spans = spans_of(text, reach)
                base = [s for s in spans if s[1] < BASE]
                for k in range(BASE):
                    counts[k].append(sum(s[1] == k for s in base))
                digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                joined.append(_joined(spans))
                found.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(joined, pa.string()), pa.array(found, struct)], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "found"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def redact(text: str | None, mark: str = "[SECRET]", reach: int | None = None) -> str | None:
    """text with each span, overlapping ones as one, replaced by mark; texts without spans stay as they are."""
    if not text:
        return text
    out, at = [], 0
    for a, _, b in spans_of(text, reach):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]]) if out else text


def redact_documents(docs: DataFrame, mark: str = "[SECRET]", reach: int | None = None, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """docs, all rows and columns, with redacted texts and their numbers of code points; other texts stay as they are."""
    names = docs.columns
    at_text, at_chars = names.index(text_col), names.index(chars_col)

    def run(batches):
        for batch in batches:
            old = batch.column(at_text).to_pylist()
            new = [redact(t, mark, reach) for t in old]
            chars = [c if a is b or a == b else len(b) for a, b, c in zip(old, new, batch.column(at_chars).to_pylist(), strict=True)]
            columns = list(batch.columns)
            columns[at_text], columns[at_chars] = pa.array(new, columns[at_text].type), pa.array(chars, columns[at_chars].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(read_table(spark, sf_dir, "documents")).drop("found")
