"""Secrets in texts, found by one automaton for all rules."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from probeline.llm.automaton import Automaton
from probeline.llm.common import DOCUMENT_COLUMNS, batch, lean, slices, utf8

#: Bytes stepped through the automaton together.
SCAN_BYTES = 32 << 20


@dataclass(frozen=True)
class Rule:
    """A match of ``pattern`` counts if its first group (or all of it) has ``least`` characters or more. ``extend`` says
    where a match that ends at a place really ends; it costs the automaton no states."""

    kind: str
    pattern: str
    least: int = 1
    extend: Callable[[bytes, int], int] | None = None


_KEY_EDGE = re.compile(rb"-----(BEGIN|END) [A-Z ]*PRIVATE KEY-----")
#: What may follow a key's first line if its last one is missing: header fields, then lines of base64 (line breaks may
#: be written as escapes). Runs too long for a word count without a line of their own.
_BREAK = rb"(?:\\r|\\n|\r|\n)"
_KEY_LINES = re.compile(
    rb"(?:[\x20\t]*%(b)s+[\x20\t]*(?:Proc-Type|DEK-Info|Comment|Version):[^\r\n\\]*)*"
    rb"(?:(?:[\x20\t]|%(b)s)*[A-Za-z0-9+/]{40,}={0,2}"
    rb"|[\x20\t]*%(b)s{1,2}[\x20\t]*[A-Za-z0-9+/]+={0,2}(?=[\x20\t]*(?:%(b)s|\Z)))*" % {b"b": _BREAK}
)


def key_end(text: bytes, at: int) -> int:
    """Where the private key ends whose first line ends at ``at``: after its last line, else after its base64 lines."""
    edge = _KEY_EDGE.search(text, at)
    if edge and edge[1] == b"END":
        return edge.end()
    return _KEY_LINES.match(text, at).end()


#: Base rules, then the rules this scan adds. Lengths are checked after the match: counters of several rules that
#: run at once would multiply the automaton's states. Only hex counts in the pattern, as any word holds short runs;
#: its runs are maximal, so a short one can't hide a longer one.
RULES = (
    Rule(
        "assign",
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        8,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]{32,}"),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 36),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", extend=key_end),
)
BASE_KINDS = ("assign", "access", "hex")


class Scanner:
    """Rules compiled on the driver; tasks get the transition arrays."""

    def __init__(self, rules: Sequence[Rule] = RULES) -> None:
        self.rules = tuple(rules)
        self.forward = Automaton([r.pattern for r in rules])
        self.backward = [Automaton([r.pattern], search=False, backward=True) for r in rules]

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, int]]]:
        """Per text its ``(start, end, rule)`` in order. ``data`` has one byte per code point.

        Leftmost and non-overlapping within a rule: the forward pass says where matches end, the backward
        automaton where the first one begins, and the pattern itself confirms it and gives the group.
        """
        found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(offsets) - 1)]
        exact = [re.compile(r.pattern.encode()) for r in self.rules]
        at, text, done = -1, b"", [0] * len(self.rules)
        for doc, end, bits in self.forward.ends(data, offsets):
            if doc != at:
                at, text, done = doc, data[offsets[doc] : offsets[doc + 1]].tobytes(), [0] * len(self.rules)
            for k, rule in enumerate(self.rules):
                if not bits >> k & 1 or end <= done[k]:
                    continue
                start = self.backward[k].first_start(text, end, done[k])
                if start < 0:
                    continue
                match = exact[k].match(text, start)
                done[k] = rule.extend(text, match.end()) if rule.extend else match.end()
                group = match.group(1) if match.re.groups else match.group()
                if len(group) >= rule.least:
                    found[doc].append((start, done[k], k))
        return [sorted(spans, key=lambda s: (s[0], s[2])) for spans in found]


def points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One byte per code point: lead bytes stay, continuation bytes go."""
    lead = (data & 0xC0) != 0x80
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(lead, out=before[1:])
    return data[lead], before[offsets]


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """The text with each run of overlapping spans replaced by ``mark``."""
    out, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            out += [text[at:start], mark]
        elif end <= at:
            continue
        at = max(at, end)
    return "".join([*out, text[at:]])


def _scanned(column: pa.Array, scanner: Scanner) -> Iterator[tuple[int, list[list[tuple[int, int, int]]]]]:
    data, offsets = utf8(column)
    for low, high in slices(offsets, SCAN_BYTES):
        own = offsets[low : high + 1]
        yield low, scanner.spans(*points(data[own[0] : own[-1]], own - own[0]))


def scan_secrets(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``doc_id`` and ``spans`` (start, end, kind) of each document, in code points with exclusive ends.

    Spans are leftmost and non-overlapping within a kind; kinds may overlap. A null or empty text has none.
    Rows are scanned one by one, so repeats are kept; other columns are ignored. A rule must be such that no
    match begins before another one and ends after it has ended, other than by running on.
    """
    scanner = Scanner(rules)
    kinds = [r.kind for r in scanner.rules]
    out = "doc_id bigint, spans array<struct<start:int,end:int,kind:string>>"
    shape = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
    schema = pa.schema([("doc_id", pa.int64()), ("spans", shape)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for low, spans in _scanned(rows.column("text"), scanner):
                dicts = [[{"start": s, "end": e, "kind": kinds[k]} for s, e, k in own] for own in spans]
                yield batch({"doc_id": rows.column("doc_id")[low : low + len(dicts)], "spans": dicts}, schema)

    return docs.select("doc_id", "text").mapInArrow(lean(scan), out)


def redact_secrets(docs: DataFrame, rules: Sequence[Rule] = RULES, mark: str = "[secret]") -> DataFrame:
    """The columns of documents with every span replaced by ``mark`` and ``n_chars`` counted anew.

    A text without secrets, a null one included, is left as it is. Only the columns of documents are returned.
    """
    scanner = Scanner(rules)
    chosen = docs.select(*DOCUMENT_COLUMNS)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts, counts = rows.column("text").to_pylist(), rows.column("n_chars").to_pylist()
            for low, spans in _scanned(rows.column("text"), scanner):
                for i, own in enumerate(spans, low):
                    if own:
                        texts[i] = redacted(texts[i], own, mark)
                        counts[i] = len(texts[i])
            new = {"text": pa.array(texts, rows.schema.field("text").type), "n_chars": pa.array(counts, pa.int64())}
            yield pa.RecordBatch.from_arrays(
                [new.get(f.name, rows.column(f.name)) for f in rows.schema], names=rows.schema.names
            )

    return chosen.mapInArrow(lean(scan), chosen.schema)
