"""Document fingerprints by SpotSigs (operator 8).

A spot is an anchor with the chain of content words that follow it. Anchors are common words, the start of a
text and one content word in eight, picked by its hash, so that texts in any language and tables have anchors all over. A text
whose start is its only anchor has one spot, all its content words. The set of a text's spots is its fingerprint,
written as the sorted 64-bit hashes of the spots. Two fingerprints are compared by Jaccard likeness.

Near-duplicates (:func:`spot_classes`): sets are dealt to ranges of lengths such that a pair of likeness ``least`` or
more shares a range or touches two neighbours. In a range, sets meet in a cell for each of their rarest spots (the
prefix: of such a pair at least one is the same). Every set of a cell is first compared with one of them,
the same for the whole cell, by pruned likeness. Cells in which more than one component is left then (of cells with
the same sets, one) are split by sketches, a few bits for each spot, which tell most unlike sets apart without doubt. What still
hangs together and has several components is linked by a spanning forest, with likeness computed only where lengths allow it.

Scale: each text is shuffled once, by ranges of ids, so that neighbours meet; the first text of a range
also goes to the range before it. The ranges' bounds, eight bytes for about a thousand rows, are all that
the driver sees. For classes, a cell's row is two numbers, combined before the shuffle, and whole sets
travel only to a pair or a part of a cell that sketches leave open; copies of a set are one there. A cell with more
than ``most`` spots is dealt to pairs of its blocks, so that no task has to hold a whole cell. How rare a spot is, is
read from counts of 2^18 buckets of spots, two megabytes that all tasks know.

Rows: null and empty texts have no spot and the empty fingerprint; two such are alike (1.0) and of one class, and one of
them is unlike any other (0.0). Very long texts are read whole. Null ids come first; of rows with one id the hash of the text tells the
order, and equal rows are one another's neighbours. A class of null ids alone has the null class. Extra
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricloom.llm.common import arrow_schema, blobs, ddl, documents, release, slices, stored, words
from metricloom.llm.components import connected_components

#: Common words of English, German, French and Spanish.
ANCHORS = tuple(
    "the of and to in is it that this for was on are with as be by an have from or had at not but what all were when we there can "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei "
    "le la les et des en un une du dans est que pour qui au par sur pas plus ne se ce il sont avec "
    "el los las y del se lo una por con no para su al como más pero sus o".split()
)
#: Spots are ordered by how many there are in their bucket: what is frequent stands out against what is spread evenly.
BUCKET_BITS = 18
_STRIP = b".,;:!?()[]{}\"'*#%&$|-_/<>=+`~"


class _Kinds(dict):
    """Of each word the word without signs around it, and whether it is a common word (2), an anchor besides (1) or
    none (0). Short words, ``most`` at a time, are kept."""

    def __init__(self, anchors: frozenset[bytes], most: int = 1 << 17):
        self.anchors, self.most = anchors, most

    def __missing__(self, word: bytes) -> tuple[bytes, int]:
        if len(self) >= self.most:
            self.clear()
        w = word.strip(_STRIP) or word
        told = w, 2 if w in self.anchors else int(not zlib.crc32(w) & 7)
        if len(word) <= 64:
            self[word] = told
        return told


def spots(blob: bytes, kinds: _Kinds, chain: int = 2, distance: int = 1) -> set[bytes]:
    """Anchor and chain of each spot; a chain at the end of the text may be shorter. A text of anchors
    alone is one spot."""
    content: list[bytes] = []
    found: list[tuple[bytes, int]] = [(b"^", 0)]
    for word in words(blob):
        w, kind = kinds[word]
        if kind < 2:
            content.append(w)
        if kind:
            found.append((w, len(content)))
    if not content:
        return {b" ".join(w for w, _ in found)} if len(found) > 1 else set()
    span, n = chain * distance, len(content)
    if (chain, distance) == (2, 1):  # the same, and most of the time spent on a text
        chains = [*map(b" ".join, zip(content, content[1:])), content[-1]]
    else:
        chains = [b" ".join(content[k : k + span : distance]) for k in range(n)]
    out = {w + b" " + chains[k] for w, k in found if k < n}
    return out if len(out) > 1 else {b" ".join((b"^", *content))}


class Prints:
    """Sorted hashes of a text's spots; built once in each task."""

    def __init__(self, anchors: tuple[str, ...] = ANCHORS, chain: int = 2, distance: int = 1):
        self.kinds, self.chain, self.distance = _Kinds(frozenset(a.encode() for a in anchors)), chain, distance

    def __call__(self, blob: bytes) -> np.ndarray:
        return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, spots(blob, self.kinds, self.chain, self.distance)), np.uint64))


def written(hashes: np.ndarray) -> str:
    return hashes.astype(">u8").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard likeness of two sorted sets; 0.0 as soon as it can't be ``least``."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(large):
        return 1.0
    if len(small) < least * len(large):
        return 0.0
    need = least / (1 + least) * (len(a) + len(b))  # the least overlap
    half = len(small) // 2 if least and len(small) > 64 else 0
    common = _overlap(small[:half], large) if half else 0
    if half and common + len(small) - half < need - 1e-9:
        return 0.0
    common += _overlap(small[half:], large)
    found = common / (len(a) + len(b) - common)
    return found if found >= least else 0.0


def _overlap(small: np.ndarray, large: np.ndarray) -> int:
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    return int((large[at] == small).sum())


def _key(i, h) -> tuple:
    return (i is not None, i, h) if i is not None else (False, 0, h)


def _deal(firsts, leads: bool):
    """Rows (id, h, value) to their range, with ``leads`` the first of a range also to the range before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = firsts.value
        for batch in batches:
            keys = [_key(i, h) for i, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            own = [bisect_right(cuts, k) - 1 for k in keys]
            lead = [r for r, (k, b) in enumerate(zip(keys, own, strict=True)) if leads and cuts[b] == k]
            rows = pa.array([*range(len(keys)), *lead], pa.int32())
            ranges = pa.array([*own, *((own[r] - 1) % len(cuts) for r in lead)], pa.int32())
            after = pa.array([False] * len(keys) + [True] * len(lead), pa.bool_())
            yield pa.RecordBatch.from_arrays([ranges, after, *(c.take(rows) for c in batch.columns)], names=["range", "after", "id", "h", "value"])

    return run


def _neighbours(make: Prints, out: pa.Schema):
    """Rows (range, after, is_text, id, h, text, class), sorted, to one row for each text that is not ``after``.
    A row that is no text tells the class of the texts behind it with its id and h."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = told = None  # (range, id, text, fingerprint, class), (id, h, class)
        for batch in slices(batches):
            rows = []
            columns = [batch.column(k).to_pylist() for k in (0, 1, 2, 3, 4, 6)]
            for place, after, is_text, i, h, root, blob in zip(*columns, blobs(batch.column(5)), strict=True):
                if not is_text:
                    told = (i, h, root)
                    continue
                if held and held[0] != place:
                    raise RuntimeError(f"range {held[0]} has no end")
                text = blob.decode("utf-8", "replace")
                mine = None if after and not held else make(blob)
                if held:
                    _, own_id, own, its, its_class = held
                    cut = len(own) // 4
                    edited = (own[: len(own) - cut] + text[:cut]).encode()
                    other = make(edited) if cut else its
                    rows.append((own_id, len(own), hashlib.sha256(edited).hexdigest(), written(its), written(other), likeness(its, other), likeness(its, mine), its_class))
                held = None if after else (place, i, text, mine, told[2] if told and told[:2] == (i, h) else None)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)
        if held:
            raise RuntimeError(f"range {held[0]} has no end")

    return run


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("value"))


def with_neighbours(
    df: DataFrame, make: Prints | None = None, id_col: str = "doc_id", text_col: str = "text", rows_a_range: int = 1 << 10, least: float | None = None
) -> DataFrame:
    """One row for each row of ``df``: id, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``,
    ``near_edited``, ``near_next`` and ``class_id``. The edited text has, for its last quarter, the first as many code
    points of the next row by id (after the last row: of the first). The class is that of :func:`spot_classes` for
    ``least``, null without it."""
    spark, make = df.sparkSession, make or Prints()
    keyed = _keyed(df, id_col, text_col)
    kind = df.schema[id_col].dataType
    measured = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    schema = T.StructType([T.StructField(id_col, kind), *ddl(measured), T.StructField("class_id", kind)])
    ids = keyed.select("id", "h")
    n = max(1, min(1 << 16, -(-ids.count() // rows_a_range)))
    first = ids.repartitionByRange(n, "id", "h").groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct(F.col("id").isNotNull().alias("k"), "id", "h")).alias("m"))
    cuts = sorted({_key(r.m.id, r.m.h) for r in first.collect()})
    if not cuts:
        return spark.createDataFrame([], schema)
    places = spark.sparkContext.broadcast(cuts)

    def dealt(rows: DataFrame, leads: bool) -> DataFrame:
        fields = T.StructType([*ddl("range int, after boolean"), T.StructField("id", kind), *ddl("h bigint"), T.StructField("value", rows.schema["value"].dataType)])
        return rows.mapInArrow(_deal(places, leads), fields)

    routed = dealt(keyed, True).select("range", "after", F.lit(True).alias("is_text"), "id", "h", F.col("value").alias("text"), F.lit(None).cast(kind).alias("class_id"))
    if least is not None:
        docs, classes = _classes(keyed, make, least)
        each = docs.join(classes, "key").groupBy("id", "h").agg(F.min("class_id").alias("value"))
        told = dealt(each.select("id", "h", "value"), False)
        routed = routed.unionByName(told.select("range", "after", F.lit(False).alias("is_text"), "id", "h", F.lit(None).cast("string").alias("text"), F.col("value").alias("class_id")))
    sorted_rows = routed.repartition("range").sortWithinPartitions("range", "after", "id", "h", "is_text")
    return sorted_rows.mapInArrow(_neighbours(make, arrow_schema(schema)), schema)


def _sets_of(make: Prints, out: pa.Schema):
    """Rows (id, h, text) to (id, h, key, short, spots, n, sketch): the digest of the set, its first eight bytes, the sorted hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [make(x) for x in blobs(batch.column(2))]
            keys = [hashlib.md5(x.tobytes()).digest() for x in sets]
            short = np.frombuffer(b"".join(x[:8] for x in keys), np.int64)
            columns = [pa.array(keys, pa.binary()), pa.array(short), pa.array([x.tobytes() for x in sets], pa.binary()), pa.array([len(x) for x in sets], pa.int32()), pa.array([sketch(x).tobytes() for x in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], schema=out)

    return run


def _count_spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets to (bucket, spots of sets in it), summed in the task. A spot's bucket is its first bits."""
    n = np.zeros(1 << BUCKET_BITS, np.int64)
    for batch in slices(batches):
        spots = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64)
        n += np.bincount((spots >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=len(n))
    used = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used])], names=["bucket", "n"])


def length_ranges(least: float, longest: int, wide: int = 4) -> np.ndarray:
    """First length of each range. A range is so wide that most sets have no partner in the next."""
    starts = [1]
    while starts[-1] <= longest:
        starts.append(int(starts[-1] / least**wide + 1e-9) + 1)
    return np.array(starts)


def _to_cells(counted, least: float, starts: np.ndarray):
    """Sets (short, spots) to one row (cell, short) for each spot of their prefix, in their range of lengths and
    in the next one if that has lengths of partners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counted.value
        for batch in slices(batches):
            cells, shorts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for short, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(blob, np.uint64)
                often = counts[(x >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
                prefix = x[np.lexsort((x, often))][: len(x) - int(np.ceil(least * len(x) - 1e-9)) + 1]
                own = int(np.searchsorted(starts, len(x), side="right"))
                ranges = [own, own + 1] if len(x) / least + 1e-9 >= starts[own] else [own]
                cells += [prefix + np.uint64(r * 0x9E3779B97F4A7C15 % (1 << 64)) for r in ranges]
                shorts.append(np.full(len(ranges) * len(prefix), short, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cells).view(np.int64)), pa.array(np.concatenate(shorts))], names=["cell", "short"])

    return run


def sketch(x: np.ndarray) -> np.ndarray:
    """Parities of how many spots have the same last bits, as many of them (a power of two, at least 128) as there are
    spots, packed in bytes. Half as many parities are the first half xor the second: see :func:`folded`."""
    bits = max(128, 1 << (len(x) - 1).bit_length())
    return np.packbits(np.bincount((x & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1 == 1)


def folded(sketches: np.ndarray, width: int) -> np.ndarray:
    """Sketches, along the last axis, of ``width`` bytes."""
    while sketches.shape[-1] > width:
        half = sketches.shape[-1] // 2
        sketches = sketches[..., :half] ^ sketches[..., half:]
    return sketches


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which sketches differ: no more than their sets differ in spots, as a spot changes one parity."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def may_be_near(n: int, m: int, a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """False only if sets of n and m spots with the sketches a and b can't have likeness ``least``: sets that have it differ
    in at most (1 - least) / (1 + least) of n + m spots."""
    width = min(len(a), len(b))
    return bool(_differ(folded(a, width), folded(b, width)) <= (1 - least) / (1 + least) * (n + m) + 1e-9)


def sketch_parts(sizes: list[int], sketches: list[np.ndarray], least: float) -> list[list[int]]:
    """The sets dealt to parts, so that two which may be near are in one part."""
    sizes = np.array(sizes, np.int64)
    by_width: dict[int, list[int]] = {}
    for i, x in enumerate(sketches):
        by_width.setdefault(len(x), []).append(i)
    rest = {w: np.array(own) for w, own in by_width.items()}
    held: dict[tuple[int, int], np.ndarray] = {(w, w): np.stack([sketches[i] for i in own]) for w, own in by_width.items()}
    out = []
    for first in range(len(sketches)):
        w = len(sketches[first])
        if not len(rest[w]) or not (rest[w] == first).any():
            continue
        part, todo = [], [first]
        keep = rest[w] != first
        rest[w] = rest[w][keep]
        held.update({at: m[keep] for at, m in held.items() if at[0] == w})
        while todo:
            k = todo.pop()
            part.append(k)
            for w, own in rest.items():
                if not len(own):
                    continue
                n, m, width = sizes[k], sizes[own], min(w, len(sketches[k]))
                if n < least * m.min() - 1e-9 or m.max() < least * n - 1e-9:
                    continue
                if (w, width) not in held:
                    held[w, width] = folded(held[w, w], width)
                near = _differ(held[w, width], folded(sketches[k], width)) <= (1 - least) / (1 + least) * (n + m) + 1e-9
                near &= (n >= least * m - 1e-9) & (m >= least * n - 1e-9)
                if near.any():
                    todo += own[near].tolist()
                    rest[w] = own[~near]
                    held.update({at: x[~near] for at, x in held.items() if at[0] == w})
        out.append(part)
    return out


def _split_groups(least: float):
    """Rows (group, key, root, n, sketch), sorted by group, to (part, key) of the parts that have several roots. Parts of the
    same sets have the same number, wherever they are found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def parts() -> list[tuple[int, str]]:
            found = []
            if len({root for _, root, _, _ in rows}) > 1:
                for part in sketch_parts([n for _, _, n, _ in rows], [np.frombuffer(x, np.uint8) for *_, x in rows], least):
                    if len({rows[i][1] for i in part}) > 1:
                        keys = sorted(rows[i][0] for i in part)
                        number = xxhash.xxh3_64_intdigest("".join(keys)) - (1 << 63)
                        found += [(number, key) for key in keys]
            rows.clear()
            return found

        def told(found: list[tuple[int, str]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.int64()), pa.array([k for _, k in found], pa.string())], names=["part", "key"])

        for batch in slices(batches):
            found = []
            for group, *row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if group != now:
                    found += parts()
                    now = group
                rows.append(tuple(row))
            yield told(found)
        yield told(parts())

    return run


def _pairs(least: float, whole: bool):
    """Rows (a, b, n of a, n of b, spots of a, spots of b) to those (a, b) that have likeness ``least`` or, by sketches, may have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, m = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            xs, ys = ([np.frombuffer(x, np.uint64 if whole else np.uint8) for x in batch.column(k).to_pylist()] for k in (4, 5))
            kept = [likeness(x, y, least) > 0 if whole else may_be_near(i, j, x, y, least) for i, j, x, y in zip(n, m, xs, ys, strict=True)]
            yield batch.select([0, 1]).filter(pa.array(kept, pa.bool_()))

    return run


def set_forest(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links (newly reached, reached from) that connect what pairs of likeness ``least`` connect."""
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    sizes = np.array([len(sets[i]) for i in order], np.int64)
    bounds = np.append(0, np.cumsum(sizes))
    spots = np.concatenate([np.zeros(0, np.uint64), *(sets[i] for i in order)])
    owner = np.repeat(np.arange(len(order)), sizes)
    waiting, out = np.ones(len(order), bool), []
    for first in range(len(order)):
        if not waiting[first]:
            continue
        waiting[first], todo = False, [first]
        while todo:
            k = todo.pop()
            low, high = np.searchsorted(sizes, [least * sizes[k] - 1e-9, sizes[k] / least + 1e-9], side="left")
            if not waiting[low:high].any():
                continue
            x, part = sets[order[k]], spots[bounds[low] : bounds[high]]
            at = np.searchsorted(x, part)
            at[at == len(x)] = 0
            common = np.bincount(owner[bounds[low] : bounds[high]][x[at] == part] - low, minlength=high - low)
            near = np.flatnonzero(waiting[low:high] & (common >= least * (sizes[k] + sizes[low:high] - common) - 1e-9)) + low
            waiting[near] = False
            out += [(order[i], order[k]) for i in near.tolist()]
            todo += near.tolist()
    return out


def _link_groups(least: float):
    """Rows (group, key, spots), sorted by group, to links (a, b) of keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, sets = None, [], []

        def told(found: list[tuple[str, str]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.string()) for k in range(2)], names=["a", "b"])

        def links() -> list[tuple[str, str]]:
            found = [(keys[i], keys[j]) for i, j in set_forest(sets, least)] if len(keys) > 1 else []
            keys.clear()
            sets.clear()
            return found

        for batch in batches:
            found = []
            for group, key, blob in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if group != now:
                    found += links()
                    now = group
                keys.append(key)
                sets.append(np.frombuffer(blob, np.uint64))
            yield told(found)
        yield told(links())

    return run


def marked(rows: DataFrame, needed: DataFrame) -> DataFrame:
    """Of ``rows`` all whose ``short`` is in ``needed`` and few others, without a shuffle of them. The numbers are hashes, and
    their first bits are looked up in 2^24 bits, which all tasks know as 2^18 rows at most."""
    word, bit = F.shiftrightunsigned("short", 64 - BUCKET_BITS), F.shiftrightunsigned("short", 64 - BUCKET_BITS - 6).bitwiseAND(63).cast("int")
    bits = needed.groupBy(word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits"))
    held = rows.withColumn("word", word).join(F.broadcast(bits), "word")
    return held.where(F.call_function("getbit", "bits", bit) == 1).select(rows.columns)


def _classes(keyed: DataFrame, make: Prints, least: float, most: int = 1 << 22) -> tuple[DataFrame, DataFrame]:
    """Of rows (id, h, text) the stored tables (id, h, key), with a row for each, and (key, class_id)."""
    if not 0 < least <= 1:
        raise ValueError("the least likeness is above 0 and at most 1")
    spark = keyed.sparkSession
    schema = T.StructType([T.StructField("id", keyed.schema["id"].dataType), *ddl("h bigint, key binary, short bigint, spots binary, n int, sketch binary")])
    every = stored(keyed.mapInArrow(_sets_of(make, arrow_schema(schema)), schema), "spots")
    docs, some = stored(every.select("id", "h", "key"), "docs"), every.where("n > 0")
    longest = some.agg(F.max("n")).first()[0]
    summed = stored(some.select("spots").mapInArrow(_count_spots, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")), "counts")
    told, counts = summed.toArrow(), np.zeros(1 << BUCKET_BITS, np.int64)
    counts[told["bucket"].to_numpy()] = told["n"].to_numpy()
    release(summed)
    counted = spark.sparkContext.broadcast(counts)
    # a cell matters if it has two sets that differ; the set with the least number is compared with all others
    cells = some.select("short", "spots").mapInArrow(_to_cells(counted, least, length_ranges(least, longest or 0)), "cell bigint, short bigint")
    shared = stored(cells.groupBy("cell").agg(F.min("short").alias("lead"), F.max("short").alias("last")).where("lead <> last").select("cell", "lead"), "cells")
    met = stored(cells.join(shared, "cell").distinct(), "met")
    release(shared)
    found = stored(met.select("short").union(met.select("lead")).distinct(), "found")
    once = [F.any_value(c).alias(c) for c in ("n", "sketch")]
    sets = stored(some.select("short", "key", "n", "sketch").join(found, "short", "left_semi").groupBy("short", F.hex("key").alias("key")).agg(*once), "sets")
    release(found)
    near = (F.col("n") >= F.col("m") * least - 1e-9) & (F.col("m") >= F.col("n") * least - 1e-9)

    def whole(needed: DataFrame) -> DataFrame:
        """The spots of the sets with these ``short``, each set once."""
        own = marked(some.select("short", "key", "n", "spots"), needed).join(needed.distinct(), "short")
        return own.groupBy("short", F.hex("key").alias("key")).agg(F.any_value("n").alias("n"), F.any_value("spots").alias("spots"))

    def joined(pairs: DataFrame, side: DataFrame, name: str) -> DataFrame:
        a = side.select(F.col("short").alias("a"), F.col("n"), F.col(name).alias("a_spots"))
        b = side.select(F.col("short").alias("b"), F.col("n").alias("m"), F.col(name).alias("b_spots"))
        return pairs.join(a, "a").join(b, "b").where(near).select("a", "b", "n", "m", "a_spots", "b_spots")

    # pairs are told apart by lengths, then by sketches, and only then by whole sets
    star = met.where("short <> lead").select(F.col("short").alias("a"), F.col("lead").alias("b")).distinct()
    likely = stored(joined(star, sets, "sketch").mapInArrow(_pairs(least, False), "a bigint, b bigint"), "likely")
    in_pairs = stored(whole(likely.select(F.col("a").alias("short")).union(likely.select("b"))), "in-pairs")
    found_links = stored(joined(likely, in_pairs, "spots").mapInArrow(_pairs(least, True), "a bigint, b bigint"), "found-links")
    a, b = (sets.select(F.col("short").alias(x), F.col("key").alias(f"{x}_key")) for x in ("a", "b"))
    links = stored(found_links.join(a, "a").join(b, "b").select(F.col("a_key").alias("a"), F.col("b_key").alias("b")), "spot-links")
    release(likely, in_pairs, found_links)
    roots = stored(connected_components(links).withColumnRenamed("node", "key"), "roots")
    # cells of three and more sets in more than one component; of cells with the same sets one is enough
    named = sets.select("short", "key", "n").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    left = stored(met.select("cell", "short").join(named, "short"), "left")
    size, marks = F.sum(F.col("n").cast("long")).alias("size"), [F.bit_xor(F.xxhash64(x)).alias(f"by_{x}") for x in ("short", "key")]
    mixed = left.groupBy("cell").agg(size, F.count(F.lit(1)).alias("sets"), F.min("root").alias("low"), F.max("root").alias("high"), *marks)
    mixed = mixed.where("low <> high and sets > 2").groupBy("sets", "size", "by_short", "by_key").agg(F.min("cell").alias("cell"))
    mixed = mixed.select("cell", F.ceil(F.col("size") / most).cast("int").alias("blocks"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    blocks = left.join(mixed, "cell").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).withColumn("other", other)
    group = F.xxhash64("cell", F.least("block", "other"), F.greatest("block", "other")).alias("group")
    members = blocks.select(group, "key", "root").join(sets.select("key", "n", "sketch"), "key").select("group", "key", "root", "n", "sketch")
    split = members.repartition("group").sortWithinPartitions("group").mapInArrow(_split_groups(least), "part bigint, key string")
    parts = stored(split.distinct(), "parts")
    release(left, met)
    in_parts = stored(whole(parts.join(sets, "key").select("short")), "in-parts")
    release(every, sets)
    grouped = parts.join(in_parts.select("key", "spots"), "key").select("part", "key", "spots")
    more = stored(grouped.repartition("part").sortWithinPartitions("part").mapInArrow(_link_groups(least), "a string, b string"), "spot-links")
    release(in_parts, parts)
    if not more.isEmpty():
        release(roots)
        roots = stored(connected_components(links.union(more)).withColumnRenamed("node", "key"), "roots")
    release(links, more)
    each = docs.groupBy("key").agg(F.min("id").alias("least_id"))
    linked = roots.withColumn("key", F.unhex("key")).join(each, "key")
    moved = linked.join(linked.groupBy("root").agg(F.min("least_id").alias("class_id")), "root").select("key", "class_id")
    classes = stored(each.join(moved, "key", "left").select("key", F.coalesce("class_id", "least_id").alias("class_id")), "classes")
    release(roots)
    return docs, classes


def spot_classes(df: DataFrame, make: Prints | None = None, least: float = 0.8, most: int = 1 << 22, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: id and ``class_id``, the smallest id that links of likeness ``least`` reach.
    Texts without spots are one class."""
    docs, classes = _classes(_keyed(df, id_col, text_col), make or Prints(), least, most)
    return docs.join(classes, "key").select(F.col("id").alias(id_col), "class_id")


def op8_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_neighbours(documents(spark, sf_dir), least=0.8)
