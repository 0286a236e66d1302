"""Near-duplicates by SimHash fingerprints and by the Jaccard likeness of word shingles.

Texts whose fingerprints (see :mod:`metricloom.llm.simhash`) are within three bits link, and so do those too unlike
for that whose likeness is high enough; a group is what links of either kind connect. The rest is on the likeness.

Each text is the set of its shingles' hashes (32 bits); equal sets are one from the start. Candidates meet
in cells: a cell is ``width`` minima of the set under as many permutations, and each set has ``bands`` of
them. Every link is verified with both whole sets. Of pairs at likeness 0.8 the bands miss a share of
(1 - 0.8 ** 4) ** 28, 4e-7, fewer at higher likeness (2e-9 at 0.85); nothing else is left out.

Two passes: first each member of a cell is compared with the cell's least member. Cells whose members then
are in one class are done; in the others (of three members or more, one for each set of members) the sets
meet, and a spanning forest is built that compares a set that has been reached only with those not reached.

Scale: a set is sent only if it has a candidate, once for the first pass's pairs and then only to cells that
hold several classes. A cell is never gathered in one task in the first pass; in the second, one with over
``most`` shingles is dealt to pairs of its blocks, so no task holds it whole, but the pairs of blocks of a
very large cell of unlike classes grow with the square of its size.

Rows: null and empty texts are one group; a text shorter than a shingle is one shingle, a very long one is the whole
set of its shingles. Rows with equal or null ids are told apart by their place in the files; extra columns stay; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.llm.common import arrow_schema, blobs, ddl, release, slices, stored, words
from metricloom.llm.components import connected_components
from metricloom.llm.keeping import PLACE, first_of, one_of_each, placed
from metricloom.llm.simhash import fingerprint, near_links

CHUNK = 1 << 12


def shingles(blob: bytes, shingle: int = 5) -> np.ndarray:
    """Sorted hashes."""
    w = words(blob)
    if not w:
        return np.zeros(0, np.uint32)
    grams = zip(*(islice(w, k, None) for k in range(shingle))) if len(w) >= shingle else iter([w])
    return np.unique(np.fromiter(map(xxhash.xxh32_intdigest, map(b" ".join, grams)), np.uint32))


class Bands:
    def __init__(self, bands: int = 28, width: int = 4, seed: int = 42):
        rng = np.random.default_rng(seed)
        self.bands, self.width = bands, width
        self.times = rng.integers(1 << 62, 1 << 63, bands * width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.plus = rng.integers(0, 1 << 63, bands * width, dtype=np.uint64)

    def __call__(self, x: np.ndarray) -> list[int]:
        """The cells of a set."""
        least = np.full(self.bands * self.width, np.iinfo(np.uint64).max, np.uint64)
        for k in range(0, len(x), CHUNK):
            mixed = self.times[:, None] * x[None, k : k + CHUNK].astype(np.uint64)
            mixed += self.plus[:, None]
            least = np.minimum(least, mixed.min(axis=1))
        cells = least.reshape(self.bands, self.width)
        return [xxhash.xxh3_64_intdigest(row.tobytes(), seed=k) - (1 << 63) for k, row in enumerate(cells)]


def _keyed(shingle: int, bands: Bands, out: pa.Schema):
    """Rows (text, ...) to rows (key, cells, fp, ...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = blobs(batch.column(0))
            sets = [shingles(x, shingle) for x in texts]
            keys = pa.array([xxhash.xxh3_64_intdigest(x.tobytes()) - (1 << 63) for x in sets], pa.int64())
            cells = pa.array([bands(x) if len(x) else [] for x in sets], out.field(1).type)
            fps = pa.array(np.array([fingerprint(x) for x in texts], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([keys, cells, fps, *batch.columns[1:]], schema=out)

    return run


def _sets(shingle: int):
    """Rows (text, key) to rows (key, set, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingles(x, shingle) for x in blobs(batch.column(0))]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([x.tobytes() for x in sets], pa.binary()), pa.array([len(x) for x in sets], pa.int32())], names=["key", "set", "n"])

    return run


def _alike(common: np.ndarray, n: np.ndarray, m: np.ndarray, least: float) -> np.ndarray:
    return common >= least * (n + m - common) - 1e-9


def _verified(least: float):
    """Rows (a, b, set of a, set of b) to those links (a, b) that are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            pairs = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            held = []
            for x, y in ((np.frombuffer(p, np.uint32), np.frombuffer(q, np.uint32)) for p, q in pairs):
                held.append(bool(_alike(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), least)))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(held, pa.bool_()))

    return run


def forest(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links (newly reached, reached from) that connect what pairs of this likeness connect."""
    sizes, rest = np.array([len(x) for x in sets], np.int64), np.arange(len(sets))
    spots, owner = np.concatenate([np.zeros(0, np.uint32), *sets]), np.repeat(rest, sizes)
    waiting, todo, out = np.ones(len(sets), bool), [], []
    while True:
        if not todo:
            rest = rest[waiting[rest]]
            if len(rest) < 2:
                return out
            todo = [int(rest[0])]
            waiting[todo[0]] = False
        k = todo.pop()
        x = sets[k]
        at = np.searchsorted(x, spots)
        at[at == len(x)] = 0
        common = np.bincount(owner[x[at] == spots], minlength=len(sets))[rest] if len(x) else np.zeros(len(rest), int)
        near = rest[waiting[rest] & _alike(common, sizes[k], sizes[rest], least)]
        if len(near):
            waiting[near] = False
            out += [(i, k) for i in near.tolist()]
            todo += near.tolist()
            left = waiting[owner]
            spots, owner, rest = spots[left], owner[left], rest[waiting[rest]]


def _link_groups(least: float):
    """Rows (group, key, set), sorted by group, to links (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sets = None, {}

        def links() -> list[tuple[int, int]]:
            keys = list(sets)
            found = [(keys[i], keys[j]) for i, j in forest(list(sets.values()), least)]
            sets.clear()
            return found

        def told(found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(2)], names=["a", "b"])

        for batch in slices(batches):
            found = []
            for group, key, blob in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if group != now:
                    found += links()
                    now = group
                sets[key] = np.frombuffer(blob, np.uint32)
            yield told(found)
        yield told(links())

    return run


def similar_links(own: DataFrame, each: DataFrame, shingle: int, least: float, most: int, text_col: str) -> DataFrame:
    """``node`` and ``root`` for every key that is linked, of ``each(key, cells, first)``: one row for each set."""
    cells = each.select("key", F.explode("cells").alias("cell"))
    several = cells.groupBy("cell").agg(F.min("key").alias("low"), F.count(F.lit(1)).alias("members")).where("members > 1")
    met = stored(cells.join(several, "cell"), "met")
    need = each.select("key", *(F.col(f"first.{c}").alias(c) for c in PLACE)).join(met.select("key").distinct(), "key", "left_semi")
    texts = own.select(F.col(text_col).alias("text"), *PLACE).join(need, list(PLACE)).select("text", "key")
    sets = stored(texts.mapInArrow(_sets(shingle), "key long, set binary, n int"), "candidates")
    pairs = met.where("key <> low").select(F.col("key").alias("a"), F.col("low").alias("b")).distinct()
    with_a = pairs.join(sets.select(F.col("key").alias("a"), F.col("set").alias("x")), "a")
    both = with_a.join(sets.select(F.col("key").alias("b"), F.col("set").alias("y")), "b").select("a", "b", "x", "y")
    links = stored(both.mapInArrow(_verified(least), "a long, b long"), "alike")
    roots = stored(connected_components(links), "roots")
    classed = met.where("members > 2").join(roots.withColumnRenamed("node", "key"), "key", "left").select("cell", "key", F.coalesce("root", "key").alias("class"))
    mixed = classed.groupBy("cell").agg(F.min("class").alias("p"), F.max("class").alias("q"), F.count(F.lit(1)).alias("members"), F.bit_xor(F.xxhash64("key")).alias("x"), F.sum(F.hash("key").cast("long")).alias("y"))
    once = stored(mixed.where("p <> q").groupBy("members", "x", "y").agg(F.min("cell").alias("cell")).select("cell"), "mixed")
    if not once.isEmpty():
        dealt = met.select("cell", "key").join(once, "cell").join(sets, "key")
        blocks = dealt.groupBy("cell").agg(F.ceil(F.sum("n") / most).cast("int").alias("blocks"))
        held = dealt.join(blocks, "cell").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
        other = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        grouped = other.select(F.xxhash64("cell", F.least("block", "other"), F.greatest("block", "other")).alias("group"), "key", "set")
        more = stored(grouped.repartition("group").sortWithinPartitions("group").mapInArrow(_link_groups(least), "a long, b long"), "alike")
        roots = stored(connected_components(links.unionByName(more)), "roots")
        release(more)
    release(met, sets, links, once)
    return roots


def joined_roots(prints: DataFrame, alike: DataFrame, near: DataFrame) -> DataFrame:
    """``node`` and ``root`` of the keys that are linked, by ``alike(node, root)`` of keys, by ``near(node, root)`` of
    fingerprints or by equal fingerprints, in any mix. ``prints(key, fp)`` are the fingerprints of each key's texts."""
    by_key, by_fp = alike.select(F.col("node").alias("key"), "root"), near.select(F.col("node").alias("fp"), F.col("root").alias("near"))
    held = prints.join(by_key, "key", "left").join(by_fp, "fp", "left")
    pairs = stored(held.select(F.coalesce("root", "key").alias("a"), F.coalesce("near", "fp").alias("fp")).distinct(), "joined")
    low = pairs.groupBy("fp").agg(F.min("a").alias("b"), F.max("a").alias("last")).where("b <> last").select("fp", "b")
    higher = stored(connected_components(pairs.join(low, "fp").select("a", "b")), "joined-roots")
    release(pairs)
    moved = by_key.join(higher.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select(F.col("key").alias("node"), F.coalesce("top", "root").alias("root"))
    return moved.unionByName(higher.join(alike, "node", "left_anti").select("node", "root"))


def keep_one(df: DataFrame, shingle: int = 5, least: float = 0.8, most: int = 1 << 21, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", distance: int = 3) -> DataFrame:
    """The rows of ``df``, with all their columns, of which each group keeps one: the one with the smallest id (null
    last), then the first in the files. Groups are what links of SimHash fingerprints within ``distance`` bits and links
    of likeness ``least`` connect."""
    own = placed(df)
    schema = ddl("key long, cells array<bigint>, fp long")
    for c in (id_col, *PLACE):
        schema = schema.add(df.schema[c] if c == id_col else own.schema[c])
    docs = own.select(text_col, id_col, *PLACE).mapInArrow(_keyed(shingle, Bands(seed=seed), arrow_schema(schema)), schema)
    once = [first_of(id_col).alias("first"), F.any_value("cells").alias("cells")]
    every = stored(docs.groupBy("key", "fp").agg(*once), "prints")
    again = [F.min("first").alias("first"), F.any_value("cells").alias("cells")]
    each = stored(every.groupBy("key").agg(*again).select("key", "first.none", "first", "cells"), "sets")
    prints = stored(every.select("key", "fp"), "keyed-prints")
    release(every)
    near = stored(connected_components(near_links(prints.select("fp").distinct(), distance)), "near-roots")
    alike = similar_links(own, each, shingle, least, most, text_col)
    return one_of_each(own, each, stored(joined_roots(prints, alike, near), "roots"), "key")
