"""Mixing sources to target weights by cube-method balanced sampling (operator 3).

Every document of a source gets the same rate, target / size of the source, between 0 and 3: it is
taken floor(rate) times and once more with the fraction as inclusion probability. The cube method makes
those draws: in a flight, the probabilities move along the null space of two constraints (the number of
documents and the number of words taken), until each is 0 or 1 but for two at most. Flights run in
blocks of a source; what is left of each block flies again with the leftovers of other blocks, until one
block is left for a source. There the last one or two documents land: the count constraint is given up,
then the word constraint.

Scale: only id, source and size travel, never a text. Blocks have a bounded number of documents, so a hot
source is many blocks; each round leaves at most two documents of a block, and blocks of a later round
take many blocks' leftovers. Draws depend on ids, sizes and the seed alone: reruns agree whatever the
partitions.

Rows: a null or empty text has size 0, a very long one is counted whole, and a source without words has target 0. A null source is a source
of its own, behind all others. Equal sizes and ids are drawn in the order of a hash, equal rows alike in any order. Repeated rows and ids are drawn one by one; null ids too. Extra columns
are ignored by :func:`mix_sources`. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.llm.common import WORD, documents, stored
from metricloom.llm.keeping import PLACE, placed

BLOCK = 1 << 12


EPS = 1e-9


def _settle(held: list[int], p: list[float], size: list[float], at: int, draws) -> list[int]:
    """Move each held unit to 0 or 1 while all units from ``at`` on make up for it, each by a part that is
    linear in its size, so that both sums stay. Whoever meets a bound first ends the move; after four moves
    the sum of p is given up, and all units move alike."""
    for j in list(held):
        rest = np.array(p[at:])
        sizes = np.array(size[at:])
        for attempt in range(8):
            free = (rest > EPS) & (rest < 1 - EPS)
            n, s1, s2 = free.sum(), sizes[free].sum(), (sizes[free] ** 2).sum()
            det = n * s2 - s1 * s1
            if not s1:
                break
            if attempt < 4 and det > 1e-9 * n * s2:
                u = np.where(free, (size[j] * s1 - s2 + (s1 - n * size[j]) * sizes) / det, 0.0)
            else:  # a unit so large that the others can't keep the count as well
                u = np.where(free, -size[j] / s1, 0.0)
            with np.errstate(divide="ignore", invalid="ignore"):
                up = min(1 - p[j], np.where(u > 0, (1 - rest) / u, np.where(u < 0, -rest / u, np.inf)).min())
                down = min(p[j], np.where(u < 0, (1 - rest) / -u, np.where(u > 0, rest / u, np.inf)).min())
            step = up if next(draws) * (up + down) < down else -down
            p[j] += step
            rest = rest + step * u
            rest[free & (rest <= EPS)] = 0.0
            rest[free & (rest >= 1 - EPS)] = 1.0
            if not EPS < p[j] < 1 - EPS:
                p[j] = float(p[j] >= 0.5)
                held.remove(j)
                break
        p[at:] = rest.tolist()
    return held


def flight(p: np.ndarray, sizes: np.ndarray, rng: np.random.Generator, constraints: int = 2) -> np.ndarray:
    """Move ``p`` (each in 0 to 1) along the null space of the sums of p and of p * size, or of the latter
    alone (``constraints`` 1), or of nothing (0), until at most ``constraints`` are strictly between 0 and 1.

    Units enter one by one; a move needs one unit more than there are constraints. A unit much larger than
    the others hardly moves, so at half of the words, three quarters and so on, those that are held settle
    against all that are still to come: with sizes in falling order only small units are left at the end."""
    p, size = p.astype(float).tolist(), sizes.astype(float).tolist()
    held: list[int] = []
    draws = iter(rng.random(2 * len(p) + 600).tolist())
    to_come = np.append(np.cumsum(sizes[::-1].astype(float))[::-1], 0.0)
    settle_at = to_come[0] / 2
    for i in range(len(p)):
        if constraints == 2 and to_come[i] <= settle_at and len(p) - i > 3:
            held = _settle(held, p, size, i, draws)
            settle_at = to_come[i] / 2
        x = p[i]
        if not EPS < x < 1 - EPS:
            p[i] = float(x >= 0.5)
            continue
        held.append(i)
        if len(held) <= constraints:
            continue
        if constraints == 2:
            a, b, c = (size[j] for j in held)
            u = (b - c, c - a, a - b)
            if not any(u):
                u = (1.0, -1.0, 0.0)
        elif constraints == 1:
            a, b = (size[j] for j in held)
            u = (b, -a) if a or b else (1.0, -1.0)
        else:
            u = (1.0,)
        up = min(((1 - p[j]) / d if d > 0 else p[j] / -d) for j, d in zip(held, u, strict=True) if d)
        down = min((p[j] / d if d > 0 else (1 - p[j]) / -d) for j, d in zip(held, u, strict=True) if d)
        step = up if next(draws) * (up + down) < down else -down
        left = []
        for j, d in zip(held, u, strict=True):
            p[j] += step * d
            if EPS < p[j] < 1 - EPS:
                left.append(j)
            else:
                p[j] = float(p[j] >= 0.5)
        held = left
    return np.array(p)


def _draws(key: str, seed: int) -> np.random.Generator:
    return np.random.default_rng([seed, zlib.crc32(key.encode())])


def _fly(seed: int, last: bool):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["size", "spread", "id_text"], ascending=[False, True, True], kind="stable", na_position="last")
        rng = _draws(f"{block['source'].iloc[0]}|{block['block'].iloc[0]}|{len(block)}", seed)
        p, sizes = block["p"].to_numpy(), block["size"].to_numpy()
        for k in (2, 1, 0) if last else (2,):
            p = flight(p, sizes, rng, k)
        return block.assign(p=p)

    return run


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """``source``, ``n``, ``source_size``, ``target`` from ``sizes(source, size)``.

    Sources in the order of their code points (null last) weigh ``weights``, repeating, and share the sum
    of all sizes; a target stops at ``most`` times the source's size, and what is above is shared anew.
    The sources stay a distributed table: their places come from sorted ranges and the ranges' counts, and
    each round of sharing is one aggregate.
    """
    per = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    ranged = stored(
        per.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last()).select("*", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("place")),
        "sources",
    )
    counts = {r["range"]: r["n"] for r in ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a range
    before, at = {}, 0
    for k in sorted(counts):
        before[k], at = at, at + counts[k]
    offset = F.create_map(*[F.lit(x) for k in before for x in (k, before[k])]) if before else F.create_map(F.lit(0), F.lit(0))
    weight = F.array(*[F.lit(float(w)) for w in weights])[((F.col("place") + offset[F.col("range")]) % len(weights)).cast("int")]
    table = stored(ranged.select("source", "n", "source_size", weight.alias("weight")), "weights")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    cap, level = F.col("source_size") * float(most), None
    low = 0.0  # targets of sources with cap / weight at or below this stop at their cap
    while True:
        stopped = F.col("weight") * low >= cap
        held, open_weight = table.agg(F.sum(F.when(stopped, cap)), F.sum(F.when(~stopped, F.col("weight")))).first()
        if not open_weight:
            break
        level = (total - (held or 0.0)) / open_weight
        above = table.where(~stopped & (F.col("weight") * level > cap)).agg(F.count(F.lit(1))).first()[0]
        if not above:
            break
        low = level
    share = F.least(cap, F.col("weight") * (level if level is not None else 0.0))
    return table.select("source", "n", "source_size", share.alias("target"))


def mix_sources(df: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of ``df``: id, ``size``, ``source_size``, ``target``, ``copies``, ``taken`` (copies times
    size) and the columns ``keep``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = stored(df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), *(F.col(c).alias(f"kept{k}") for k, c in enumerate(keep))), "sizes")
    kept = [f"kept{k}" for k in range(len(keep))]
    targets = source_targets(docs, weights, most)
    joined = docs.join(targets, docs["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate + 1e-12)
    spread = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "size", F.lit(seed))
    ready = joined.select(
        "doc_id", "source", "size", "source_size", "target", whole.alias("copies"), F.greatest(rate - whole, F.lit(0.0)).alias("p"),
        spread.alias("spread"), F.col("doc_id").cast("string").alias("id_text"), F.ceil(F.col("n") / BLOCK).alias("blocks"), *kept,
    ).withColumn("block", F.expr("pmod(spread, blocks)"))
    largest = targets.agg(F.max("n")).first()[0] or 0
    blocks, settled = -(-largest // BLOCK), None
    open_p = (F.col("p") > 0) & (F.col("p") < 1)
    while True:
        last = blocks <= 1
        flown = ready.groupBy("source", "block").applyInPandas(_fly(seed, last), ready.schema)
        if last:
            part = flown
            settled = part if settled is None else settled.unionByName(part)
            break
        flown = stored(flown, "flown")
        part = flown.where(~open_p)
        settled = part if settled is None else settled.unionByName(part)
        width = BLOCK // 4  # leftovers, two of a block at most, of so many blocks make one of the next round
        ready = flown.where(open_p).withColumn("blocks", F.ceil(F.col("blocks") / width)).withColumn("block", F.floor(F.col("block") / width))
        blocks = -(-blocks // width)
    copies = F.col("copies") + F.round("p").cast("long")
    return settled.select(F.col("doc_id").alias(id_col), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *(F.col(k).alias(c) for k, c in zip(kept, keep, strict=True)))


def take_mix(df: DataFrame, **options) -> DataFrame:
    """The rows of ``df`` that the mix takes, with all their columns and ``size``, ``copies`` and ``taken`` behind them (a
    column of ``df`` with such a name is an error: it would be lost). A row is known by its place in the files that
    ``df`` is read from, or is written to, so repeated and null ids do not matter."""
    if clash := {"size", "copies", "taken"} & set(df.columns):
        raise ValueError(f"rename {', '.join(sorted(clash))}: the mix adds columns of that name")
    own = placed(df)
    taken = mix_sources(own, keep=PLACE, **options).where("copies > 0").select(*PLACE, "size", "copies", "taken")
    return own.join(taken, list(PLACE)).drop(*PLACE)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")
