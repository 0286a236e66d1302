"""Language identification by nearest centroids (operator 5).

A text is the vector of its character 1- to 3-grams (of letters in lower case, by UTF-8 byte, hashed),
with sublinear counts, inverse document frequencies and length 1. Each language has several centroids,
found by spherical k-means; the language of the nearest centroid by cosine is the prediction. A text
that is farther from its nearest centroid than any sample text of that language and of its length, by a margin,
is rejected.

Document frequencies cover all training texts; they come from sums made in each task, of the fixed size of the
feature table. Only the k-means runs on a sample: of each language the ``per_lang`` distinct texts with the least
hashes. Each language's k-means is a task of its own, of bounded size. There may be any number of languages:
their centroids are a table in the shared folder, and prediction broadcasts ``block`` languages at a time, one
block after the other against all texts (one pass without shuffle for up to ``block`` languages).

Rows: a text that is null or has no letter (Unicode category L) is ``und`` with score 0 and is rejected. Rows with
null lang or null text do not train. Repeated rows count in the frequencies and once in the sample; repeated and
null ids are rows like others. A text as near to two languages gets the first by name. Very long texts are counted
whole, in chunks. Extra columns are ignored by :func:`identify` and kept by :func:`keep_identified`. With nothing to
learn from all is ``und``. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql import types as T

from metricloom.llm.common import arrow_schema, documents, id_crc, slices, stored

SIZE = 1 << 14
_LETTERS = re.compile(r"[^\W\d_]+")
_NO_LETTERS = {c: " " for c in range(128, sys.maxunicode + 1) if (x := chr(c)).isalnum() and not x.isalpha()}  # digits, fractions, numerals
_ODD = frozenset(map(chr, _NO_LETTERS))
_MIX = np.uint32(2654435761)
_CHUNK = 1 << 20


def gram_counts(text: str | None) -> np.ndarray | None:
    """Counts by feature; None if there is no letter."""
    text = (text or "").lower()
    odd = not text.isascii() and not _ODD.isdisjoint(set(text))  # a set, as a regex of so many characters takes most of the time
    found = _LETTERS.findall(text.translate(_NO_LETTERS) if odd else text)
    if not found:
        return None
    data = np.frombuffer(f" {' '.join(found)} ".encode("utf-8", "replace"), np.uint8)
    total = np.zeros(SIZE, np.int64)
    for at in range(0, len(data), _CHUNK):
        b = data[at : at + _CHUNK + 2].astype(np.uint32)
        n = min(_CHUNK, len(data) - at)
        total[: 256] += np.bincount(b[:n], minlength=256)[:256]
        two = b[:-1] << np.uint32(8) | b[1:]
        for codes in (two[:n], (two[:-1] << np.uint32(8) | b[2:])[:n] + np.uint32(1 << 24)):
            total += np.bincount((codes * _MIX >> np.uint32(18)).astype(np.int64), minlength=SIZE)
    return total


def vector(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(counts)
    v = (1 + np.log(counts[at])) * idf[at]
    return at, (v / (np.linalg.norm(v) or 1.0)).astype(np.float32)


@dataclass
class Block:
    """Some languages, in order."""

    langs: list[str]  # of each centroid
    centroids: np.ndarray  # feature by centroid
    least: np.ndarray  # of each centroid: least cosine by the logarithm of the length
    idf: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, float] | None:
        """Language, cosine and the least cosine that is not rejected."""
        counts = gram_counts(text)
        if counts is None:
            return None
        at, v = vector(counts, self.idf)
        near = v @ self.centroids[at]
        best = int(near.argmax())
        return self.langs[best], float(min(1.0, max(0.0, near[best]))), float(self.least[best, _bin(counts)])


@dataclass
class Model:
    """``table(lang, centroid, least)`` is as long as there are languages; None with nothing to learn from."""

    table: DataFrame | None
    idf: np.ndarray
    block: int

    @property
    def langs(self) -> list[str]:
        return [] if self.table is None else [r.lang for r in self.table.select("lang").distinct().orderBy("lang").collect()]

    def blocks(self) -> Iterator[Block]:
        """``block`` languages at a time, as they stream to the driver."""
        held: list = []
        rows = [] if self.table is None else self.table.orderBy("lang", "centroid").toLocalIterator()
        made = lambda: Block([r.lang for r in held], np.column_stack([np.frombuffer(r.centroid, np.float32) for r in held]), np.array([r.least for r in held]), self.idf)
        for k, (_, own) in enumerate(groupby(rows, key=lambda r: r.lang)):
            if k and not k % self.block:
                yield made()
                held.clear()
            held += own
        if held:
            yield made()


def _bin(counts: np.ndarray) -> int:
    return min(31, int(np.log2(max(1, counts[:256].sum()))))


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from a farthest-first start; centroids of length 1, at most k."""
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-12)
    centers = [unit(x.mean(axis=0))]
    while len(centers) <= k and len(centers) <= len(x):
        centers.append(x[int(np.max(x @ np.array(centers).T, axis=1).argmin())])
    c = np.array(centers[1:])
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        c = unit(np.array([x[own == i].mean(axis=0) if (own == i).any() else c[i] for i in range(len(c))]))
    return np.unique(c, axis=0)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to (feature, documents with it); feature -1 counts the documents."""
    df, n = np.zeros(SIZE, np.int64), 0
    for batch in slices(batches):
        for text in batch.column(0).to_pylist():
            if (counts := gram_counts(text)) is not None:
                df += counts > 0
                n += 1
    used = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1), pa.int32()), pa.array(np.append(df[used], n))], names=["feature", "n"])


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text, order) to (lang, order, features, counts)."""
    for batch in slices(batches):
        lang, rank, feature, times = [], [], [], []
        for c, text, h in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if (counts := gram_counts(text)) is not None:
                at = np.flatnonzero(counts)
                lang.append(c)
                rank.append(h)
                feature.append(at.astype(np.int16))
                times.append(counts[at].astype(np.int32))
        kinds = [pa.string(), pa.int64(), pa.list_(pa.int16()), pa.list_(pa.int32())]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((lang, rank, feature, times), kinds, strict=True)], names=["lang", "rank", "feature", "times"])


def _centroids(idf, centroids: int, margin: float):
    """The sample of one language to its centroids."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("rank")
        x, bins = np.zeros((len(table), SIZE), np.float32), []
        for i, row in enumerate(x):
            counts = np.zeros(SIZE, np.int64)
            counts[table["feature"][i].values.to_numpy()] = table["times"][i].values.to_numpy()
            at, v = vector(counts, idf.value)
            row[at] = v
            bins.append(_bin(counts))
        own = kmeans(x, centroids)
        near = np.full(32, np.inf)
        np.minimum.at(near, bins, (x @ own.T).max(axis=1))
        low = np.zeros(32)  # a length without a sample takes the least of those above it, or nothing
        for b in range(32):
            if np.isfinite(near[b]):
                low[b] = margin * near[b:].min()
            elif b and np.isfinite(near[:b]).any():
                low[b] = low[b - 1]
        columns = [pa.array([table["lang"][0].as_py()] * len(own), pa.string()), pa.array([c.tobytes() for c in own], pa.binary()), pa.array([low.tolist()] * len(own), pa.list_(pa.float64()))]
        return pa.table(columns, names=["lang", "centroid", "least"])

    return run


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang", centroids: int = 4, per_lang: int = 400, margin: float = 0.5, block: int = 128) -> Model:
    """A model from all rows of ``df`` that have text and lang."""
    sc = df.sparkSession.sparkContext
    rows = df.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    idf, n = np.zeros(SIZE), 0
    for r in rows.select("text").mapInArrow(_frequencies, "feature int, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).collect():  # SIZE + 1 rows at most
        if r.feature < 0:
            n = r.n
        else:
            idf[r.feature] = r.n
    if not n:
        return Model(None, idf, block)
    idf = np.log((1 + n) / (1 + idf)) + 1
    letters = F.col("text").rlike(r"\p{L}")
    ranked = rows.select("lang", F.when(letters, F.xxhash64("text")).alias("rank")).where("rank is not null").distinct()
    ranked = ranked.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("rank"))).where(F.col("place") <= per_lang)  # cut in each task before it is dealt
    last = stored(ranked.groupBy("lang").agg(F.max("rank").alias("last")), "languages")
    picked = rows.withColumn("rank", F.xxhash64("text")).join(last, "lang").where("rank <= last").select("lang", "text", "rank")
    sets = picked.mapInArrow(_sparse, "lang string, rank bigint, feature array<smallint>, times array<int>")
    sample = sets.groupBy("lang", "rank").agg(F.any_value("feature").alias("feature"), F.any_value("times").alias("times"))
    found = sample.groupBy("lang").applyInArrow(_centroids(sc.broadcast(idf), centroids, margin), "lang string, centroid binary, least array<double>")
    return Model(stored(found, "centroids"), idf, block)


def _predicted(df: DataFrame, model: Model, text_col: str) -> DataFrame:
    """``df`` with ``__lang``, ``__score`` and ``__least`` (null without a prediction) behind its columns."""
    own, more = len(df.columns), [T.StructField("__lang", T.StringType()), T.StructField("__score", T.DoubleType()), T.StructField("__least", T.DoubleType())]
    at, schema = df.columns.index(text_col), T.StructType([*df.schema.fields, *more])
    out, first = arrow_schema(schema), True
    rows = df.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in more))

    def step(rows: DataFrame, shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                said = list(zip(*(c.to_pylist() for c in batch.columns[own:]), strict=True))
                for i, text in enumerate(batch.column(at).to_pylist()):
                    new = shared.value.predict(text)
                    if new and (said[i][1] is None or new[1] > said[i][1]):
                        said[i] = new
                yield pa.RecordBatch.from_arrays([*batch.columns[:own], *(pa.array([x[k] for x in said], out.field(own + k).type) for k in range(3))], schema=out)

        return rows.mapInArrow(run, schema)

    for some in model.blocks():
        rows, first = step(rows if first else stored(rows, "predicted"), df.sparkSession.sparkContext.broadcast(some)), False
    return rows


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: id, ``lang_pred``, ``score`` (cosine) and ``rejected``."""
    said = _predicted(df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")), model, "__text")
    rejected = F.coalesce(F.col("__score") < F.col("__least"), F.lit(True))
    return said.select(F.col("__id").alias(id_col), F.coalesce("__lang", F.lit("und")).alias("lang_pred"), F.coalesce("__score", F.lit(0.0)).alias("score"), rejected.alias("rejected"))


def keep_identified(df: DataFrame, model: Model, text_col: str = "text", lang_col: str | None = None) -> DataFrame:
    """The rows of ``df``, with all their columns, that are not rejected; ``lang_col``, if named, gets the prediction."""
    kept = _predicted(df, model, text_col).where("__score >= __least")
    return kept.select(*(F.col("__lang").cast(df.schema[c].dataType).alias(c) if c == lang_col else F.col(f"`{c}`") for c in df.columns))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = id_crc(F.col("doc_id")) % 4 == 2
    model = train(docs.where(~held_out))
    return identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")
