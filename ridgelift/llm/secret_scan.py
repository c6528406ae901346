"""Secret scans with a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over trigrams: wherever the expression must pass
through one of a few literal strings, every match holds all trigrams of at least one of them. Each task indexes the
texts of its batch (trigram -> posting list of texts, lower-cased ASCII), evaluates every rule's query by intersecting
and uniting postings, and runs the expression only over the texts that remain. A rule without mandatory
trigrams scans every text. Index, lookup and verification stay in one task, so nothing is shuffled and no hot key exists.

Nulls: a null text is the empty text, without secrets; a null id stays null. Spans that start together are told in the order of the rules. Columns besides id and text are not read, so
their names cannot clash. Repeated rows get equal results. An empty table gives an empty
result. Texts are scanned whole, whatever their length. Offsets count code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
import re._constants as C
import re._parser as P
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: The fewest characters of `group` that a match needs; shorter matches are dropped.
    group: int = 0
    least: int = 1


# The three base kinds, then the kinds added here, in the order in which ties are listed.
ASSIGN = r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
BASE_RULES = (
    Rule("assign", ASSIGN, 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),  # the same spans as [0-9a-f]+ of 24 characters or more
)
ADDED_RULES = (
    Rule("temporary-access", r"ASIA[A-Z0-9]{16}"),
    Rule("code-host-token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat-token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("maps-key", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("payment-key", r"[srp]k_live_[0-9A-Za-z]{16,}"),
    Rule("web-token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private-key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("url-password", r"://[A-Za-z0-9_.-]+:[^\s:@/]{6,}@"),
)
RULES = BASE_RULES + ADDED_RULES
#: Larger sets of alternatives are given up as "anything".
MOST_STRINGS = 64


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """Clauses that all hold for any text with a match. A clause: alternatives, of which one has all its trigrams there. No clause: no mandatory trigrams."""
    clauses: list[list[frozenset[str]]] = []

    def flush(strings: set[str]) -> None:
        strings = {s.lower() for s in strings}
        if strings and all(len(s) >= 3 and s.isascii() for s in strings):
            clauses.append([frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in sorted(strings)])

    def finite(items) -> set[str] | None:
        """All strings that a sequence can stand for (case folded), or None if too many."""
        found = {""}
        for op, arg in items:
            if op is C.LITERAL:
                each = {chr(arg).lower()}
            elif op is C.IN:
                each = set()
                for kind, x in arg:
                    if kind is C.LITERAL:
                        each.add(chr(x).lower())
                    elif kind is C.RANGE and x[1] - x[0] < 12:
                        each |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
                    else:
                        return None
            elif op is C.BRANCH:
                parts = [finite(p) for p in arg[1]]
                if any(p is None for p in parts):
                    return None
                each = set().union(*parts)
            elif op is C.SUBPATTERN:
                each = finite(arg[3])
            elif op is C.MAX_REPEAT and arg[1] <= 8 and arg[1] is not C.MAXREPEAT:
                once = finite(arg[2])
                if once is None:
                    return None
                each, part = set(), {""}
                for n in range(int(arg[1]) + 1):
                    if n >= arg[0]:
                        each |= part
                    part = {a + b for a in part for b in once}
                    if len(part) > MOST_STRINGS:
                        return None
            else:
                return None
            if each is None:
                return None
            found = {a + b for a in found for b in each}
            if len(found) > MOST_STRINGS:
                return None
        return found

    def walk(items) -> None:
        """Clauses of a sequence that every match passes through."""
        run: set[str] = {""}
        for item in items:
            op, arg = item
            part = finite([item])
            if part is not None and len(run) * len(part) <= MOST_STRINGS:
                run = {a + b for a in run for b in part}
                continue
            flush(run)
            run = part if part is not None else {""}
            if part is None and op is C.SUBPATTERN:
                walk(arg[3])
            elif part is None and op is C.MAX_REPEAT and arg[0] >= 1:
                walk(arg[2])
        flush(run)

    walk(list(P.parse(pattern)))
    return clauses


class SegmentIndex:
    """The posting lists of a batch of texts, for the trigrams that the rules ask for."""

    STEP = 1 << 20

    def __init__(self, wanted: dict[str, int]):
        self.wanted = wanted
        self.known = np.zeros(1 << 24, np.int16)
        for t, i in wanted.items():
            a, b, c = t.encode()
            self.known[a << 16 | b << 8 | c] = i + 1

    def postings(self, data: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """data: the texts' bytes, lower-cased, each text followed by a zero byte; ends: where those stand."""
        found = []
        for at in range(0, len(data), self.STEP):
            part = data[at : at + self.STEP + 2].astype(np.uint32)
            if len(part) < 3:
                continue
            hits = self.known[part[:-2] << 16 | part[1:-1] << 8 | part[2:]]
            where = np.flatnonzero(hits)
            found.append(np.unique(np.stack([hits[where].astype(np.int64) - 1, np.searchsorted(ends, where + at)]), axis=1))
        pairs = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((2, 0), np.int64)
        cuts = np.searchsorted(pairs[0], np.arange(len(self.wanted) + 1))
        return [pairs[1][a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def candidates(self, query: list[list[frozenset[str]]], postings: list[np.ndarray], n: int) -> np.ndarray:
        left = None
        for clause in query:
            any_of = np.zeros(n, bool)
            for trigrams in clause:
                own = None
                for t in sorted(trigrams, key=lambda t: len(postings[self.wanted[t]])):
                    p = postings[self.wanted[t]]
                    own = p if own is None else np.intersect1d(own, p, assume_unique=True)
                    if not len(own):
                        break
                any_of[own] = True
            left = any_of if left is None else left & any_of
        return np.flatnonzero(left) if left is not None else np.arange(n)


def find_spans(texts: list[str], rules: tuple[Rule, ...], index: SegmentIndex, queries: list) -> list[list[tuple[int, int, int]]]:
    """For each text its spans (start, place of the rule, end), sorted."""
    raw = [t.encode("utf-8", "replace").lower() for t in texts]
    ends = np.cumsum([len(r) + 1 for r in raw]) - 1
    postings = index.postings(np.frombuffer(b"\0".join(raw) + b"\0", np.uint8), ends)
    spans: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for k, rule in enumerate(rules):
        run = re.compile(rule.pattern, re.ASCII)
        for d in index.candidates(queries[k], postings, len(texts)):
            for m in run.finditer(texts[d]):
                a, b = m.span(rule.group)
                if b - a >= rule.least:
                    spans[d].append((m.start(), k, m.end()))
    for s in spans:
        s.sort()
    return spans


def _prepared(rules: tuple[Rule, ...]):
    queries = [trigram_query(r.pattern) for r in rules]
    wanted = {t: i for i, t in enumerate(sorted({t for q in queries for clause in q for s in clause for t in s}))}
    return queries, SegmentIndex(wanted)


def _batches(batches: Iterator[pa.RecordBatch], text: str, at_most: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with about at_most bytes of text, or one text."""
    for b in batches:
        column = b.column(text)
        sizes = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0), dtype=np.int64))
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + at_most, side="right")))
            part = b.slice(at, to - at)
            yield part, [t or "" for t in part.column(text).to_pylist()]
            at = to


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, and spans: array of (kind, start, end) in order of start, then of the rules."""

    def run(batches):
        import pyarrow.compute  # noqa: F401

        queries, index = _prepared(rules)
        for part, texts in _batches(batches, "text"):
            found = [[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in s] for s in find_spans(texts, rules, index, queries)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))], ["doc_id", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """docs with every span of its text replaced by [kind]; overlapping spans become one. Same columns and rows; null texts stay null."""
    place = docs.columns.index(text_col)

    def run(batches):
        import pyarrow.compute  # noqa: F401

        queries, index = _prepared(rules)
        for part, texts in _batches(batches, text_col):
            out = []
            for t, s in zip(texts, find_spans(texts, rules, index, queries), strict=True):
                pieces, at = [], 0
                for a, k, b in s:
                    if a >= at:
                        pieces += [t[at:a], f"[{rules[k].kind}]"]
                    at = max(at, b)
                out.append("".join(pieces) + t[at:] if s else t)
            fresh = pa.array([o if x.is_valid else None for o, x in zip(out, part.column(text_col), strict=True)], part.schema.field(place).type)
            yield pa.RecordBatch.from_arrays([fresh if i == place else c for i, c in enumerate(part.columns)], schema=part.schema)

    return docs.mapInArrow(run, docs.schema)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    rules, n_base = RULES, len(BASE_RULES)

    def run(batches):
        import pyarrow.compute  # noqa: F401

        queries, index = _prepared(rules)
        for part, texts in _batches(batches, "text"):
            counts: list[list[int]] = [[], [], []]
            sha, said = [], []
            for s in find_spans(texts, rules, index, queries):
                for k in range(n_base):
                    counts[k].append(sum(x[1] == k for x in s))
                sha.append(hashlib.sha256(",".join(f"{rules[k].kind}:{a}:{b}" for a, k, b in s if k < n_base).encode()).hexdigest())
                said.append(",".join(f"{rules[k].kind}:{a}:{b}" for a, k, b in s))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(sha, pa.string()), pa.array(said, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")
