"""SimHash near-duplicates by multi-index hashing (operator 2).

A fingerprint has 64 bits over word shingles. Fingerprints within ``distance`` (up to 3) of each other
link. Of two such fingerprints one half of 32 bits differs in at most one bit, so each fingerprint
stands in two tables, one for each half, and looks in each for its half and for the ball of radius 1
around it. Of two halves that differ in one bit only the one without the bit needs to ask, which
leaves 16 asks of 32 on average. What meets in a table's cell is verified over all 64 bits.

Scale: equal fingerprints are one row from the start, so exact copies never meet. A cell gives at most
one link for each of its members (a spanning forest), never all its pairs. Cells are read as a sorted
stream; one with more than ``most`` fingerprints is not gathered but split by what it leaves open: the other half's
two parts of 16 bits, of which again one differs in at most one bit, and then the rest's two parts of 8. A
cell of that last level has at most 33 * 17 * 9 * 256 = 1.3 million fingerprints, ten megabytes, whatever the input.

Rows: null and empty texts have the fingerprint zero, which links like any other; a text shorter than a
shingle is one shingle, and a very long one is read whole, in parts. A bit set in exactly half the shingles is 0. Repeated rows and ids stay, null ids too (they are never a component's id, but
carry links). Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricloom.llm.common import arrow_schema, blobs, documents, slices, stored, words
from metricloom.llm.components import connected_components
from metricloom.llm.keeping import PLACE, firsts, one_of_each, placed

CHUNK = 1 << 15


def fingerprint(blob: bytes, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned; a bit is 1 if it is set in over half the shingles' XXH64."""
    w = words(blob)
    if not w:
        return 0
    grams = zip(*(islice(w, k, None) for k in range(shingle))) if len(w) >= shingle else iter([w])
    total, count = np.zeros(64, np.int64), 0
    while part := list(map(xxhash.xxh64_intdigest, map(b" ".join, islice(grams, CHUNK)), repeat(seed))):
        bits = np.unpackbits(np.array(part, np.uint64).view(np.uint8), bitorder="little").reshape(-1, 64)
        total += np.add.reduce(bits, axis=0, dtype=np.uint16)
        count += len(part)
    return int(np.packbits(2 * total > count, bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, ``fp`` (the fingerprint as a long of the same 64 bits) and the columns ``keep``."""
    schema = T.StructType([df.schema[id_col], T.StructField("fp", T.LongType()), *(df.schema[c] for c in keep)])
    out = arrow_schema(schema)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = np.array([fingerprint(x, shingle, seed) for x in blobs(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps), *batch.columns[2:]], schema=out)

    return df.select(id_col, text_col, *keep).mapInArrow(make, schema)


def forest(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is connected at this distance: each newly reached fingerprint and the one it
    was reached from. A fingerprint is compared only with those not reached yet."""
    rest, ends, starts = np.unique(fps), [], []
    while len(rest):
        todo, rest = [rest[:1]], rest[1:]
        while todo and len(rest):
            for x in todo.pop():
                near = np.bitwise_count(rest ^ x) <= distance
                if near.any():
                    ends.append(rest[near])
                    starts.append(np.full(near.sum(), x))
                    todo.append(rest[near])
                    rest = rest[~near]
                if not len(rest):
                    break
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *ends]), np.concatenate([none, *starts])


def _link_cells(distance: int, most: int):
    """Over rows (cell, fp, asks, rest) sorted by cell: links (a, b), or (a, null, cell, rest) for members of a
    cell that is too large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        over = None
        kinds = (np.int64, np.uint64, bool, np.int64)
        empty = tuple(np.zeros(0, k) for k in kinds)
        tail = empty

        def rows(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            none = pa.nulls(len(a), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), none, none], names=["a", "b", "cell", "rest"])

        def crowd(cell: np.ndarray, fp: np.ndarray, _, rest: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.nulls(len(fp), pa.int64()), pa.array(cell), pa.array(rest)], names=["a", "b", "cell", "rest"])

        def cells(cell: np.ndarray, fp: np.ndarray, asks: np.ndarray, _) -> Iterator[pa.RecordBatch]:
            """Whole cells."""
            if not len(cell):
                return
            at = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
            sizes = np.diff(at, append=len(cell))
            ends, starts = [], []
            for i, n in zip(at[sizes > 1], sizes[sizes > 1], strict=True):
                if not asks[i : i + n].all():
                    e, s = forest(fp[i : i + n], distance)
                    ends.append(e)
                    starts.append(s)
            if ends and len(e := np.concatenate(ends)):
                yield rows(e, np.concatenate(starts))

        for batch in batches:
            new = tuple(batch.column(k).to_numpy(zero_copy_only=False).astype(kind, copy=False) if kind is not np.uint64 else batch.column(k).to_numpy().view(kind) for k, kind in enumerate(kinds))
            if over is not None:  # go on with the cell that is too large
                n = int(np.searchsorted(new[0], over, side="right"))
                if n:
                    yield crowd(*(x[:n] for x in new))
                    new = tuple(x[n:] for x in new)
                if not len(new[0]):
                    continue
                over = None
            held = tuple(np.concatenate(x) for x in zip(tail, new, strict=True))
            if not len(held[0]):
                continue
            cut = int(np.searchsorted(held[0], held[0][-1]))
            yield from cells(*(x[:cut] for x in held))
            tail = tuple(x[cut:] for x in held)
            if len(tail[0]) > most:
                over = tail[0][0]
                yield crowd(*tail)
                tail = empty
        yield from cells(*tail)

    return run


def _unset(bits: Column, value: Column) -> Column:
    return F.filter(bits, lambda bit: value.bitwiseAND(bit) == 0)


def _cells(ball: Column, value: Column, left: Column, table: int) -> Column:
    return F.transform(ball, lambda bit: F.struct(F.xxhash64("cell", F.lit(table), value.bitwiseOR(bit)).alias("cell"), (bit != 0).alias("asks"), left.alias("rest")))


def _dealt(fps: DataFrame, width: int) -> DataFrame:
    """Rows (fp, cell, rest), of whose fingerprints those in one cell may differ only in ``rest``, of ``width`` bits, to the
    cells (cell, fp, asks, rest) of both halves of rest and of the ball of radius 1 around each."""
    part, one, asks = width // 2, F.lit(1).cast("long"), []
    mask = F.lit((1 << part) - 1).cast("long")
    for table in range(2):
        low, high = F.col("rest").bitwiseAND(mask), F.shiftrightunsigned("rest", part).bitwiseAND(mask)
        value, left = (low, high) if not table else (high, low)
        flips = F.transform(F.sequence(F.lit(0), F.lit(part - 1)), lambda i: F.call_function("shiftleft", one, i))
        asks.append(_cells(F.concat(F.array(F.lit(0).cast("long")), _unset(flips, value)), value, left, table))
    return fps.select("fp", F.explode(F.concat(*asks)).alias("x")).select("x.cell", "fp", "x.asks", "x.rest")


def near_links(fps: DataFrame, distance: int = 3, most: int = 1 << 16) -> DataFrame:
    """Links ``a``, ``b`` between distinct fingerprints ``fps(fp)`` that connect the same fingerprints as
    all pairs within ``distance`` do."""
    if not 0 <= distance <= 3:
        raise ValueError("two tables with balls of radius 1 find distances up to 3")
    open_, links = fps.select("fp", F.lit(0).cast("long").alias("cell"), F.col("fp").alias("rest")), None
    for width in (64, 32, 16):
        rows = _dealt(open_, width).repartition("cell").sortWithinPartitions("cell")
        found = stored(rows.mapInArrow(_link_cells(distance, most if width > 16 else 1 << 62), "a long, b long, cell long, rest long"), "near")
        told = found.where("b is not null").select("a", "b")
        links = told if links is None else links.unionByName(told)
        open_ = found.where("b is null").select(F.col("a").alias("fp"), "cell", "rest")
        if open_.isEmpty():
            break
    return links


def simhash_classes(df: DataFrame, shingle: int = 3, distance: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: its id, ``fingerprint`` (16 hex digits) and ``component_id``, the
    smallest id that links reach."""
    docs = stored(fingerprints(df, shingle, seed, id_col, text_col), "fingerprints")
    each = stored(docs.groupBy("fp").agg(F.min(id_col).alias("least")), "distinct")
    roots = stored(connected_components(near_links(each.select("fp"), distance)).withColumnRenamed("node", "fp"), "roots")
    linked = roots.join(each, "fp")
    ids = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    moved = roots.join(ids, "root").select("fp", "component_id")
    # a table, so that the next join has a plain shuffle on both sides and Spark can split a frequent fingerprint
    every = stored(each.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "components")
    return docs.join(every, "fp").select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, shingle: int = 3, distance: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", null_apart: bool = True) -> DataFrame:
    """The rows of ``df``, with all their columns, of which each group of near-duplicates keeps one: the
    one with the smallest id (the first of them in the files, if several rows have it). Of a group's rows with
    a null id one stays too, or, without ``null_apart``, only if no row of the group has an id."""
    own = placed(df)
    docs = stored(fingerprints(own, shingle, seed, id_col, text_col, PLACE), "fingerprints")
    each = stored(firsts(docs, "fp", id_col), "distinct")
    return one_of_each(own, each, stored(connected_components(near_links(each.select("fp").distinct(), distance)), "roots"), "fp", null_apart)


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_classes(documents(spark, sf_dir))
