"""Benchmark decontamination by the q-gram lemma (operator 6).

Texts and items are reduced to letters and digits in lower case with single spaces. An item of length m
within k edits of a region of a text shares at least m - q + 1 - k q q-grams with it, on diagonals no
more than k apart. So q-grams that occur in an item are counted in bands of k + 1 diagonals; two
neighbouring bands overlap every possible region. Regions that reach the bound are verified by an
alignment within the band. An occurrence is an item whole, within ``rate`` of its length in edits
(fewer for short items: k is at most m / q - 1, so that the bound is at least 1). An item shorter than q, if
``least`` lets it in, has to stand there exactly and as whole words.

The items are the stated query set. They are broadcast in blocks of ``block`` characters, one block at a
time against all texts: with more than one block, each pass is written to the shared folder before the
next, so that neither the driver nor a task ever holds more than one. Texts, however long, are read in windows that
overlap by the longest item; there is no shuffle, and no row depends on another. A window with more than MEETINGS
pairs of a place and an item's place with one q-gram is walked for halves of the items, then of the window, so that
neither repetitive texts nor q-grams that many items share fill a task's memory.

Rows: null and empty texts are clean; null and empty items, and those with fewer than ``least`` letters, digits
and spaces between words (a word or two, which proves nothing), occur nowhere. Items that occur at one place are
all told, by id. Repeated rows and ids and null ids are rows like others; extra columns are ignored by
:func:`find_leaks` and kept by :func:`drop_leaks`. Without items nothing is a leak.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricloom.llm.common import arrow_schema, ddl, documents, slices, stored

_WORD = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WINDOW = 1 << 20
MEETINGS = 1 << 21
LEAKS = "array<struct<item_id:bigint,start:bigint,end:bigint,distance:int>>"


def reduced(text: str | None) -> str:
    return " ".join(_WORD.findall((text or "").lower()))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _grams(points: np.ndarray, q: int) -> np.ndarray:
    h = np.zeros(max(0, len(points) - q + 1), np.uint64)
    wide = points.astype(np.uint64)
    for k in range(q if len(h) else 0):
        h *= _BASE
        h += wide[k : k + len(h)]
    return h * _BASE


def banded_distance(item: np.ndarray, region: np.ndarray, band: int) -> tuple[int, int]:
    """Least edits between the item and any part of the region, and where that part ends. Only diagonals
    (place in the region less place in the item) from -band to the difference of the lengths plus band
    are walked; within ``band`` edits that is all there is to see. More edits than that end the walk."""
    n, m, far = len(region), len(item), np.int32(1 << 20)
    last = max(0, n - m) + band
    d = np.arange(-band, last + 1)
    row = np.where(d >= 0, 0, far).astype(np.int32)
    row[d > n] = far
    steps = np.arange(len(d), dtype=np.int32)
    padded = np.concatenate([np.zeros(band, np.uint32), region, np.zeros(last + m, np.uint32)])
    for i, c in enumerate(item, 1):
        new = row + (padded[i - 1 : i - 1 + len(d)] != c)
        np.minimum(new[:-1], row[1:] + 1, out=new[:-1])
        new[d + i < 0] = far
        new[d + i > n] = far
        if 0 <= band - i:
            new[band - i] = min(new[band - i], i)
        row = np.minimum.accumulate(new - steps) + steps
        row[d + i > n] = far
        if not i % 16 and row.min() > band:
            return band + 1, 0
    at = int(row.argmin())
    return int(row[at]), m + at - band


class Items:
    """A block of benchmark items ready for search."""

    def __init__(self, items: list[tuple[int, str]], q: int, rate: float, least: int = 1):
        self.q, self.rate = q, rate
        self.items = [(i, t) for i, text in items if len(t := reduced(text)) >= max(1, least)]
        self.points = [_points(t) for _, t in self.items]
        self.budget = np.array([max(0, min(int(rate * len(p)), len(p) // q - 1)) for p in self.points], np.int64)
        size = np.array([len(p) for p in self.points], np.int64)
        self.bound = size - q + 1 - self.budget * q
        self.short = [k for k, p in enumerate(self.points) if len(p) < q]
        each = [_grams(p, q) for p in self.points]
        grams = np.concatenate([np.zeros(0, np.uint64), *each])
        owner = np.repeat(np.arange(len(each)), [len(g) for g in each])
        place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(g)) for g in each)])
        order = np.argsort(grams, kind="stable")
        self.keys, self.first, self.many = np.unique(grams[order], return_index=True, return_counts=True)
        self.owner, self.place = owner[order], place[order]
        self.code = np.repeat(np.arange(len(self.keys)), self.many) * np.int64(len(each) + 1) + self.owner  # rises with key, then item
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        self.longest = int((size + 2 * self.budget).max(initial=q))

    def search(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item's place, start, end, edits) in the reduced text, one for each region, by start."""
        found: dict[tuple[int, int], tuple[int, int]] = {}
        points = _points(text)
        for at in range(0, max(1, len(points)), _WINDOW):
            self._window(points[at : at + _WINDOW + self.longest], at, found)
        for k in self.short:
            item, padded = f" {self.items[k][1]} ", f" {text} "
            at = padded.find(item)
            while at >= 0:
                found[k, at] = (at + len(item) - 2, 0)
                at = padded.find(item, at + 1)
        return self._apart(found)

    def _window(self, points: np.ndarray, offset: int, found: dict) -> None:
        """All occurrences that lie whole in ``points``."""
        h = _grams(points, self.q)
        at = np.flatnonzero(self.maybe[(h >> np.uint64(44)).astype(np.int64)])
        if not len(at):
            return
        key = np.searchsorted(self.keys, h[at])
        key[key == len(self.keys)] = 0
        hit = self.keys[key] == h[at]
        at, key = at[hit], key[hit]
        if len(at):
            self._meet(points, offset, found, at, key, 0, len(self.points))

    def _meet(self, points: np.ndarray, offset: int, found: dict, at: np.ndarray, key: np.ndarray, low: int, high: int) -> None:
        """``at`` places of the text that have the q-gram ``key``, against the items from ``low`` to ``high``."""
        first = np.searchsorted(self.code, key * np.int64(len(self.points) + 1) + low)
        many = np.searchsorted(self.code, key * np.int64(len(self.points) + 1) + high) - first
        total = int(many.sum())
        if not total:
            return
        if total > MEETINGS and high - low > 1:
            middle = (low + high) // 2
            self._meet(points, offset, found, at, key, low, middle)
            self._meet(points, offset, found, at, key, middle, high)
            return
        if total > MEETINGS and len(points) > 4 * self.longest:
            half = len(points) // 2
            cut = half + self.longest
            self._meet(points[:cut], offset, found, at[at < cut - self.q + 1], key[at < cut - self.q + 1], low, high)
            self._meet(points[half:], offset + half, found, at[at >= half] - half, key[at >= half], low, high)
            return
        posting = np.repeat(first - np.append(0, np.cumsum(many)[:-1]), many) + np.arange(total)
        owner, where = self.owner[posting], np.repeat(at, many)
        diagonal = where - self.place[posting] + self.longest
        band = diagonal // (self.budget[owner] + 1)
        # places of the text and places of the item count once in a band: a text that repeats one q-gram of the
        # item, or an item that repeats one of the text, has few of the other
        code = owner * np.int64(1 << 32) + band
        if not self._open(*np.unique(code, return_counts=True)).any():
            return  # not even with all meetings counted
        bands, counts = np.unique(_distinct(code, where), return_counts=True)
        counts = np.minimum(counts, np.unique(_distinct(code, self.place[posting]), return_counts=True)[1])
        for c in bands[self._open(bands, counts)]:
            k = int(c >> np.int64(32))
            budget, item = int(self.budget[k]), self.points[k]
            start = int(c & np.int64(0xFFFFFFFF)) * (budget + 1) - self.longest
            low, high = max(0, start - 2 * budget - 1), min(len(points), start + len(item) + 4 * budget + 2)
            if high > low:
                edits, end = banded_distance(item, points[low:high], budget)
                if edits <= budget:
                    _, begin = banded_distance(item[::-1], points[low : low + end][::-1], budget)
                    found.setdefault((k, offset + low + end - begin), (offset + low + end, edits))

    def _open(self, bands: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Which bands meet the bound, together with a neighbour."""
        follows = np.append(bands[1:] == bands[:-1] + 1, False)
        both = counts + np.where(follows, np.append(counts[1:], 0), 0)
        lead = np.append(False, follows[:-1])  # the band before is there too: then that one's sum has this one
        need = self.bound[bands >> np.int64(32)]
        return (both >= need) | (lead & (np.append(0, both[:-1]) >= need))

    def _apart(self, found: dict) -> list[tuple[int, int, int, int]]:
        out: list[tuple[int, int, int, int]] = []
        last: dict[int, int] = {}
        for (k, start), (end, edits) in sorted(found.items(), key=lambda x: (x[0][1], x[0][0])):
            if start >= last.get(k, -1):
                out.append((k, start, end, edits))
                last[k] = end
        return out


def _distinct(code: np.ndarray, where: np.ndarray) -> np.ndarray:
    order = np.lexsort((where, code))
    code, where = code[order], where[order]
    first = np.append(True, (code[1:] != code[:-1]) | (where[1:] != where[:-1]))
    return code[first]


def original_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of the reduced text as code points of the text itself."""
    at, places = 0, []  # of each word: where it begins in the reduced text and its ends in the text
    low = text.lower()
    source = text if len(low) == len(text) else low
    for m in _WORD.finditer(low):
        places.append((at, m.start(), m.end()))
        at += m.end() - m.start() + 1
    starts = np.array([p[0] for p in places])

    def back(x: int, end: bool) -> int:
        i = max(0, int(np.searchsorted(starts, x - end, side="right")) - 1)
        begin, first, last = places[i]
        return min(first + x - begin, last)

    if source is text:
        return [(back(s, False), back(e, True)) for s, e in spans]
    shift = np.cumsum([0] + [len(c.lower()) for c in text])  # letters that grow in lower case
    return [(int(np.searchsorted(shift, back(s, False), side="right")) - 1, int(np.searchsorted(shift, back(e, True)))) for s, e in spans]


def _blocks(items: DataFrame, id_col: str, text_col: str, block: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size, as they stream to the driver."""
    held, size = [], 0
    for r in items.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("t is not null").toLocalIterator():
        held.append((r.i, r.t))
        size += len(r.t)
        if size > block:
            yield held
            held, size = [], 0
    if held:
        yield held


def _leaks_in(items: Items, text: str | None) -> list[tuple[int, int, int, int]]:
    """(item id, start, end, edits) in code points of the text."""
    if not (found := items.search(reduced(text))):
        return []
    spans = original_spans(text, [(s, e) for _, s, e, _ in found])
    return [(items.items[k][0], *span, edits) for (k, _, _, edits), span in zip(found, spans, strict=True)]


def _passes(df: DataFrame, items: DataFrame, item_id: str, item_text: str, q: int, rate: float, block: int, least: int, step) -> DataFrame:
    """``step(df, items of a block)`` for one block after the other; without items for an empty block."""
    sc, first = df.sparkSession.sparkContext, True
    for held in _blocks(items, item_id, item_text, block):
        df, first = step(df if first else stored(df, "decontaminated"), sc.broadcast(Items(held, q, rate, least))), False
    return step(df, sc.broadcast(Items([], q, rate))) if first else df


def find_leaks(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", q: int = 8, rate: float = 0.1, block: int = 4_000_000, least: int = 8) -> DataFrame:
    """One row for each row of ``df``: id and ``leaks`` (item_id, start, end, distance), by start."""
    schema = T.StructType([df.schema[id_col], T.StructField("__text", T.StringType()), *ddl(f"leaks {LEAKS}")])
    out, names = arrow_schema(schema), ("item_id", "start", "end", "distance")

    def step(rows: DataFrame, shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                leaks = []
                for text, before in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    found = before + [dict(zip(names, x, strict=True)) for x in _leaks_in(shared.value, text)]
                    leaks.append(sorted(found, key=lambda x: (x["start"], x["item_id"] is None, x["item_id"], x["end"])))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(leaks, out.field(2).type)], schema=out)

        return rows.mapInArrow(run, schema)

    none = F.expr(f"cast(array() as {LEAKS})").alias("leaks")
    return _passes(df.select(id_col, F.col(text_col).alias("__text"), none), items, item_id, item_text, q, rate, block, least, step).select(id_col, "leaks")


def drop_leaks(df: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", q: int = 8, rate: float = 0.1, block: int = 4_000_000, least: int = 8) -> DataFrame:
    """The rows of ``df``, with all their columns, in whose text no item occurs."""
    at, schema = df.columns.index(text_col), df.schema

    def step(rows: DataFrame, shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                clean = [not shared.value.search(reduced(t)) for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return rows.mapInArrow(run, schema)

    return _passes(df, items, item_id, item_text, q, rate, block, least, step)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the benchmark items that it holds."""
    found = find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    spans = F.array_join(F.transform("leaks", lambda x: F.concat_ws(":", x["item_id"].cast("string"), x["start"].cast("string"), x["end"].cast("string"), x["distance"].cast("string"))), ",")
    items = F.array_sort(F.array_distinct(F.transform("leaks", lambda x: x["item_id"])))
    return found.select("doc_id", (F.size("leaks") > 0).alias("contaminated"), F.size("leaks").cast("long").alias("n_leaks"), items.alias("item_ids"), spans.alias("leaks"))
