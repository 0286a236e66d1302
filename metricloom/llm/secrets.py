"""Secret scans by a combined deterministic automaton (operator 10).

All rules are compiled into one minimal transition table, and each text is read once, byte by byte.
Where the table says that a rule's match ends for the first time, the rule's reversed automaton walks back to the
leftmost start and its forward automaton on to the longest end. Per rule the matches are leftmost and do not
overlap: behind a match the rule goes on by an automaton of its own, which knows nothing of what began before,
until the combined one's state says the same of the rule again. So a walk back never goes behind the rule's last
match, and work is linear in the bytes for rules whose matches end where their automaton dies, as all rules here do.

Rows: null text is the empty text and has no span; every input row gives one output row, repeated
rows and null ids included; extra columns are ignored by :func:`find_secrets` and kept by
:func:`redact_secrets`. Offsets are code points, end exclusive. A text is scanned whole, however long;
nothing is gathered between rows, so no row can be hot. Of spans that begin at one place the earlier rule comes first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricloom.llm.automaton import Dfa, compile_rules, projections
from metricloom.llm.common import arrow_schema, blobs, ddl, documents, slices


@dataclass(frozen=True)
class Rule:
    """A kind of secret: ``pattern``, with ``head`` in front. ``least`` is the least number of bytes that the match
    has behind its head (the longest that the head can take); a shorter match is dropped, and the search goes on
    behind it."""

    kind: str
    pattern: str
    least: int = 0
    head: str = ""
    either_case: bool = False


#: Letters of the key in either case; the value's class has both cases already.
BASE = (
    Rule("assign", r"[A-Za-z0-9+/_.=-]+", 6, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", True),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{8,}", 24),  # as [0-9a-f]+ of 24: a run is matched whole either way; 8 keeps words from matching
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 20),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_.-]+", 40),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + MORE


@dataclass(frozen=True)
class Tables:
    """The automata of a set of rules, as the driver compiles them once and tasks get them."""

    rules: tuple[Rule, ...]
    combined: Dfa
    own: list[Dfa]
    states: list[tuple[int, ...]]  # of each rule's own automaton, by state of the combined one
    forward: list[Dfa]
    backward: list[Dfa]
    heads: list[Dfa | None]


@lru_cache(maxsize=8)
def compiled(rules: tuple[Rule, ...]) -> Tables:
    each = [[(r.head + r.pattern, r.either_case)] for r in rules]
    combined, own = compile_rules([x[0] for x in each]), [compile_rules(x) for x in each]
    heads = [compile_rules([(r.head, r.either_case)], anywhere=False) if r.head else None for r in rules]
    return Tables(rules, combined, own, projections(combined, own), [compile_rules(x, anywhere=False) for x in each], [compile_rules(x, anywhere=False, backwards=True) for x in each], heads)


class Scanner:
    def __init__(self, tables: Tables):
        self.rules = tables.rules
        all_rows, own_rows = tables.combined.rows(), [d.rows() for d in tables.own]
        for row, states in zip(all_rows, tables.states, strict=True):
            row.append([r[n] for r, n in zip(own_rows, states, strict=True)])  # place 258: each rule's own state here
        first = lambda dfa: dfa.rows()[dfa.start] if dfa else None
        self.start, self.own = all_rows[tables.combined.start], [r[d.start] for r, d in zip(own_rows, tables.own, strict=True)]
        self.forward, self.backward, self.heads = ([first(d) for d in x] for x in (tables.forward, tables.backward, tables.heads))

    def scan(self, data: bytes) -> list[tuple[int, int, int]]:
        """(rule's place, start, end) in bytes, of kept matches, by start and then rule."""
        row, found, done = self.start, [], [0] * len(self.rules)
        away: dict[int, tuple[int, list]] = {}  # rules behind a match: from where on, and their own state
        bytes_left = enumerate(data, 1)
        while True:
            for at, byte in bytes_left:
                row = row[byte]
                if row[256]:
                    break
            else:
                return sorted(found, key=lambda x: (x[1], x[0]))
            self.match(row[256], data, at, done, away, found)
            for at, byte in bytes_left:
                row = row[byte]
                if row[256]:
                    self.match(row[256], data, at, done, away, found)
                for k, (since, own) in list(away.items()):
                    if at > since:
                        own = own[byte]
                        if own[256]:
                            del away[k]
                            self.match(1 << k, data, at, done, away, found)
                        elif own is row[258][k]:
                            del away[k]
                        else:
                            away[k] = since, own
                if not away:
                    break

    def match(self, mask: int, data: bytes, at: int, done: list[int], away: dict, found: list) -> None:
        """The matches of which the first end is ``at``, of the rules in ``mask`` that are not away."""
        k = -1
        while mask:
            k, on, mask = k + 1, mask & 1, mask >> 1
            if not on or k in away:
                continue
            start, row = at, self.backward[k]
            for i in range(at - 1, done[k] - 1, -1):
                row = row[data[i]]
                if row[256]:
                    start = i
                elif not row[257]:
                    break
            row, end = self.forward[k], at
            for i in range(start, len(data)):
                row = row[data[i]]
                if row[256]:
                    end = i + 1
                elif not row[257]:
                    break
            done[k] = end
            away[k] = end, self.own[k]
            if end - self.behind_head(k, data, start) >= self.rules[k].least:
                found.append((k, start, end))

    def behind_head(self, k: int, data: bytes, start: int) -> int:
        row = self.heads[k]
        end = start
        if row:
            for i in range(start, len(data)):
                row = row[data[i]]
                if row[256]:
                    end = i + 1
                elif not row[257]:
                    break
        return end


_SCANNERS: dict[tuple[Rule, ...], Scanner] = {}


def scanner(tables: Tables) -> Scanner:
    """Made once in each Python worker."""
    if tables.rules not in _SCANNERS:
        _SCANNERS[tables.rules] = Scanner(tables)
    return _SCANNERS[tables.rules]


def in_points(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Byte offsets to code points, in one walk over the text."""
    if not spans or data.isascii():
        return spans
    points, last, count = {}, 0, 0
    for p in sorted({x for s in spans for x in s[1:]}):
        count += len(data[last:p].decode("utf-8", "replace"))
        points[p], last = count, p
    return [(k, points[s], points[e]) for k, s, e in spans]


SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def find_secrets(df: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``spans``: kind, start and end of every secret, by start and then by rule."""
    schema = T.StructType([df.schema[id_col], *ddl(f"spans {SPANS}")])
    out, names, tables = arrow_schema(schema), [r.kind for r in rules], df.sparkSession.sparkContext.broadcast(compiled(rules))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = scanner(tables.value).scan
        for batch in slices(batches):
            spans = [[{"kind": names[k], "start": s, "end": e} for k, s, e in in_points(x, find(x))] for x in blobs(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, out.field(1).type)], schema=out)

    return df.select(id_col, text_col).mapInArrow(scan, schema)


def redact_secrets(df: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", mark: str = "[secret]", length_col: str | None = None) -> DataFrame:
    """All rows and columns of ``df``, with every secret in the text replaced by ``mark`` (spans that
    overlap get one) and ``length_col``, if named, set to the new length of a changed text. A null
    text stays null."""
    at, schema = df.columns.index(text_col), df.schema
    out, length = arrow_schema(schema), df.columns.index(length_col) if length_col else None
    tables = df.sparkSession.sparkContext.broadcast(compiled(rules))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, put = scanner(tables.value).scan, mark.encode()
        for batch in slices(batches):
            texts, columns = batch.column(at).cast(pa.binary()).to_pylist(), list(batch.columns)
            sizes = columns[length].to_pylist() if length is not None else None
            for i, data in enumerate(texts):
                parts, last = [], 0
                for _, s, e in find(data) if data else ():
                    if s >= last:
                        parts += [data[last:s], put]
                    last = max(last, e)
                if parts:
                    texts[i] = b"".join([*parts, data[last:]])
                    if sizes is not None:
                        sizes[i] = len(texts[i].decode("utf-8", "replace"))
            columns[at] = pa.array(texts, pa.binary()).cast(out.field(at).type)
            if sizes is not None:
                columns[length] = pa.array(sizes, out.field(length).type)
            yield pa.RecordBatch.from_arrays(columns, schema=out)

    return df.mapInArrow(clean, schema)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its secrets, as counts, digest and spans."""
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    told = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["kind"].isin([r.kind for r in BASE]))
    return find_secrets(documents(spark, sf_dir)).select(
        "doc_id", *(count(r.kind).alias(f"n_{r.kind}") for r in BASE), F.sha2(told(base).cast("binary"), 256).alias("base_sha256"), told(F.col("spans")).alias("spans")
    )
