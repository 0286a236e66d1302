"""Toxicity by classifier chains (operator 9).

A chain has one logistic regression for each category, in order. Each sees the words of a text and, for
every earlier category, the log odds that the earlier models give it. While a model trains, those odds
are out-of-fold: a text's come from models that were fitted without its fold, so a later model learns
from predictions as good as those that it will get, not from ones that know the answer.

A text is the set of its words (letters and digits in lower case) and of their first 4 and 6 letters, so
that an ending not seen before does not hide a stem; hashed to ``2 ** bits`` features.

The models are fitted on a bounded sample of labels: about ``most`` ids with their labels, by a hash of the id, of
which half are kept for positives of the rarest category if it has so many. Repeated labels and texts are one
row with a weight; if the ids have more than four times ``most`` documents, texts are chosen in their turn by hash. Only
the chosen texts' word hashes reach the driver, which fits the models on one core, in time that depends on
``most`` alone. Prediction is one pass over all whole texts without shuffle, with a
model of fixed size.

Rows: a null or empty text has no word and gets what the models say of no words; a very long one is the set of
its words. A probability equal to the cut is a yes.
Labels without id or document don't train; a label that is null leaves the document out of that
category's model alone. A category with labels of one kind only is constant. Repeated rows and ids and null ids are rows
like others; of a document that is labelled repeatedly every label counts. Extra columns are ignored. An
empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricloom.llm.common import arrow_schema, ddl, documents, slices, stored

BITS = 20
PREFIXES = (4, 6)
_WORD = re.compile(r"[^\W_]+")


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """Sorted features of a text, each once."""
    mask = (1 << bits) - 1
    found = set(_WORD.findall((text or "").lower()))
    found |= {f"{w[:k]}*" for k in PREFIXES for w in found if len(w) > k}
    return np.unique(np.fromiter((zlib.crc32(w.encode("utf-8", "replace")) & mask for w in found), np.int32))


class Rows:
    """Sets of features as one sparse matrix, with dense columns behind it."""

    def __init__(self, sets: list[np.ndarray], size: int):
        self.n, self.size = len(sets), size
        self.owner = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
        self.at = np.concatenate([np.zeros(0, np.int32), *sets])

    def dot(self, w: np.ndarray, dense: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, w[: self.size][self.at], self.n) + dense @ w[self.size :]

    def back(self, r: np.ndarray, dense: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(self.at, r[self.owner], self.size), dense.T @ r])


def fit(rows: Rows, dense: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, rounds: int = 40, tolerance: float = 1e-4) -> np.ndarray:
    """Weights of a ridge logistic regression by L-BFGS; ``dense`` ends with the intercept's ones."""
    penalty = np.append(np.full(rows.size + dense.shape[1] - 1, ridge), 0.0)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = rows.dot(w, dense)
        value = (weight * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * (penalty * w * w).sum()
        return value, rows.back(weight * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y), dense) + penalty * w

    w = np.zeros(rows.size + dense.shape[1])
    value, grad = loss(w)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        step, alphas = grad.copy(), []
        for s, d in reversed(pairs):
            alphas.append(s @ step / (s @ d))
            step -= alphas[-1] * d
        step *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1 / max(1.0, np.abs(grad).sum())
        for (s, d), a in zip(pairs, reversed(alphas), strict=True):
            step += (a - d @ step / (s @ d)) * s
        size, slope = 1.0, grad @ step
        while size > 1e-8:
            new = w - size * step
            now, at = loss(new)
            if now <= value - 1e-4 * size * slope:
                break
            size /= 2
        else:
            break
        if (new - w) @ (at - grad) > 1e-12:
            pairs = [*pairs[-7:], (new - w, at - grad)]
        done = value - now < tolerance * abs(now)
        w, value, grad = new, now, at
        if done:
            break
    return w


def _odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p)) / 4


@dataclass
class Chain:
    categories: list[str]
    weights: list[np.ndarray]  # features, earlier categories, intercept
    cuts: list[float]  # probability from which a category is said to hold
    bits: int = BITS

    def predict(self, sets: list[np.ndarray]) -> np.ndarray:
        """Probabilities, text by category."""
        rows, out = Rows(sets, 1 << self.bits), np.zeros((len(sets), 0))
        for w in self.weights:
            dense = np.column_stack([_odds(out), np.ones(len(sets))])
            out = np.column_stack([out, 1 / (1 + np.exp(-np.clip(rows.dot(w, dense), -50, 50)))])
        return out


def train_chain(sets: list[np.ndarray], labels: np.ndarray, fold: np.ndarray, weight: np.ndarray, categories: list[str], folds: int = 5, ridge: float = 3.0, bits: int = BITS, least: int = 3) -> Chain:
    """``labels``: text by category, NaN where there is none; ``fold``: of each text, equal texts alike;
    ``weight``: for how many rows each text of the sample stands; ``least``: of how many texts a feature is."""
    n = len(sets)
    chain, out_of_fold = Chain([], [], [], bits), np.zeros((n, 0))
    used, many = np.unique(np.concatenate([np.zeros(0, np.int32), *sets]), return_counts=True)
    used = used[many >= least]  # features of few texts have weight 0
    number = np.full(1 << bits, -1, np.int32)
    number[used] = np.arange(len(used), dtype=np.int32)
    size = len(used)
    rows = Rows([(x := number[s])[x >= 0] for s in sets], size)

    def model(own: np.ndarray, y: np.ndarray, dense: np.ndarray) -> np.ndarray:
        told = own & ~np.isnan(y)
        kinds = np.unique(y[told])
        if len(kinds) < 2:  # constant
            w = np.zeros(size + dense.shape[1])
            w[-1] = (20.0 if kinds[0] else -20.0) if len(kinds) else -20.0
            return w
        return fit(rows, dense, np.where(told, y, 0.0), weight * told, ridge)

    for j, name in enumerate(categories):
        y, dense = labels[:, j], np.column_stack([_odds(out_of_fold), np.ones(n)])
        found = np.zeros(n)
        for f in range(folds):
            if (held := fold == f).any():
                z = rows.dot(model(~held, y, dense), dense)
                found[held] = 1 / (1 + np.exp(-np.clip(z[held], -50, 50)))
        chain.categories.append(name)
        w = model(np.ones(n, bool), y, dense)
        whole = np.zeros((1 << bits) + dense.shape[1], np.float32)
        whole[used], whole[1 << bits :] = w[:size], w[size:]
        chain.weights.append(whole)
        chain.cuts.append(best_cut(found, y, weight))
        out_of_fold = np.column_stack([out_of_fold, found])
    return chain


def best_cut(p: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The probability from which saying yes has the best F1 on out-of-fold predictions: the middle of the
    gap there, if there is one, within 0.2 and 0.8."""
    told = ~np.isnan(y)
    p, y, weight = p[told], y[told], weight[told]
    if not len(p) or not y.any():
        return 0.5
    order = np.argsort(-p, kind="stable")
    hits, said = np.cumsum((y * weight)[order]), np.cumsum(weight[order])
    f1 = 2 * hits / (said + (y * weight).sum())
    last = np.append(p[order][1:] != p[order][:-1], True)
    k = int(np.argmax(np.where(last, f1, -1)))
    below = p[order][k + 1] if k + 1 < len(p) else 0.0
    return float(np.clip((p[order][k] + below) / 2, 0.2, 0.8))


def sample_labelled(df: DataFrame, known: DataFrame, labels: dict[str, Column], most: int, bits: int, id_col: str, text_col: str):
    """(sets, labels, hashes, weights) of the sample. Its size is the same whatever the tables': ids are
    picked among the labels first, and only these look for their texts. They are broadcast if they are as few as
    expected, and shuffled otherwise."""
    names = [f"y{j}" for j in range(len(labels))]
    told = (F.when(c.cast("double") > 0.5, 1.0).when(c.cast("double") <= 0.5, 0.0).alias(y) for y, c in zip(names, labels.values(), strict=True))
    rows = known.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), *told).where(F.coalesce(*names).isNotNull())
    rows = rows.groupBy("id", *names).agg(F.count(F.lit(1)).alias("times"))
    counts = rows.agg(F.count(F.lit(1)).alias("n"), *(F.sum(y).alias(y) for y in names)).first()
    if not counts.n:
        return [], np.zeros((0, len(labels))), np.zeros(0, np.int64), np.zeros(0)
    rare = min(range(len(labels)), key=lambda j: counts[names[j]] or float("inf"))
    n_yes = int(counts[names[rare]] or 0)
    shares = [min(1.0, (most - most // 2) / max(1, counts.n - n_yes)), min(1.0, most // 2 / max(1, n_yes))]  # expected sizes; hashes spread evenly
    rank, share = F.xxhash64(F.col("id").cast("string")), lambda h: h / F.lit(2.0**64) + 0.5
    picked = share(rank) < F.when(F.coalesce(F.col(names[rare]), F.lit(0.0)) > 0, shares[1]).otherwise(shares[0])
    chosen = stored(rows.where(picked), "labels")
    chosen = F.broadcast(chosen) if chosen.count() <= 2 * most else chosen
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = docs.select("id").join(chosen, "id").count()
    of_texts = min(1.0, 4 * most / max(1, found))
    h = F.xxhash64("text")
    texts = docs.where(share(h) < of_texts if of_texts < 1 else F.lit(True)).join(chosen, "id").select("text", rank.alias("rank"), h.alias("h"), "times", *names)
    schema = T.StructType([*ddl("rank bigint, h bigint, times bigint"), *(T.StructField(y, T.DoubleType()) for y in names), *ddl("set array<int>")])
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = pa.array([features(t, bits) for t in batch.column(0).to_pylist()], out.field("set").type)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], sets], schema=out)

    table = texts.mapInArrow(run, schema).groupBy("rank", "h", *names).agg(F.sum("times").alias("times"), F.any_value("set").alias("set")).toArrow()
    table = table.sort_by([(c, "ascending") for c in ("rank", "h", *names)])
    y = np.column_stack([table[c].to_numpy() for c in names]) if len(table) else np.zeros((0, len(labels)))
    weight = np.where(np.nan_to_num(y[:, rare]) > 0, 1 / shares[1], 1 / shares[0]) * table["times"].to_numpy() / of_texts
    sets = [s.values.to_numpy() for s in table["set"]]
    return sets, y, table["rank"].to_numpy(), weight


def train(df: DataFrame, known: DataFrame, labels: dict[str, Column], most: int = 12_000, folds: int = 5, ridge: float = 3.0, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """A chain over ``labels`` (category to a column of ``known``: 0, 1 or null), in this order; ``known`` has the
    id of a document in each row."""
    sets, y, _, weight = sample_labelled(df, known, labels, most, bits, id_col, text_col)
    fold = np.array([zlib.crc32(s.tobytes()) % folds for s in sets], np.int64)  # equal texts share a fold
    if len(weight):
        weight = weight / weight.min()
    return train_chain(sets, y, fold, weight, list(labels), folds, ridge, bits)


def classify(df: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: id, and for every category ``p_<category>`` and ``<category>`` (whether it is said to hold)."""
    shared = df.sparkSession.sparkContext.broadcast(chain)
    schema = T.StructType([df.schema[id_col]])
    for c in chain.categories:
        schema = schema.add(f"p_{c}", T.DoubleType()).add(c, T.BooleanType())
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches):
            p = model.predict([features(t, model.bits) for t in batch.column(1).to_pylist()])
            columns = [x for j, cut in enumerate(model.cuts) for x in (pa.array(p[:, j]), pa.array(p[:, j] >= cut))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], schema=out)

    return df.select(id_col, text_col).mapInArrow(run, schema)


def op9_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the chain low quality, toxic."""
    docs = documents(spark, sf_dir)
    known = spark.read.parquet(f"{sf_dir}/labels.parquet")
    chain = train(docs, known, {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")})
    return classify(docs, chain).select("doc_id", "p_low_quality", "p_toxic", "low_quality", "toxic")
