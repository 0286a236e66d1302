import random

import numpy as np
from pyspark.sql import functions as F

from metricloom.llm import toxicity
from tests.llm.util import documents, words_of

RUDE = "idiot moron scum trash".split()
THREAT = "kill hurt burn".split()


def table(rng, n):
    """(id, text, insult, threat): threats come with insults, so the second category needs the first."""
    rows = []
    for i in range(n):
        words = words_of(rng, rng.randrange(5, 120)).split()
        insult = rng.random() < 0.2
        threat = insult and rng.random() < 0.5
        for pool, on in ((RUDE, insult), (THREAT, threat or rng.random() < 0.15)):
            for _ in range(3 * on):
                words[rng.randrange(len(words))] = rng.choice(pool)
        text = " ".join(words)
        insult = any(w in text.split() for w in RUDE)
        rows.append((i, text, int(insult), int(insult and any(w in text.split() for w in THREAT))))
    return rows


def test_gradient_reaches_the_optimum():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 30, 8)).astype(np.int32) for _ in range(400)]
    y = np.array([float(3 in s or 7 in s) for s in sets])
    rows, dense = toxicity.Rows(sets, 30), np.ones((400, 1))
    w = toxicity.fit(rows, dense, y, np.ones(400), 1.0, rounds=300, tolerance=1e-12)
    p = 1 / (1 + np.exp(-rows.dot(w, dense)))
    grad = rows.back(p - y, dense) + np.append(w[:-1], 0.0)
    assert np.abs(grad).max() < 0.05 and ((p > 0.5) == (y > 0.5)).mean() > 0.98


def test_chain_on_held_out_texts(spark):
    rng = random.Random(2)
    rows = table(rng, 900)
    df = spark.createDataFrame(rows, "doc_id bigint, text string, insult int, threat int").selectExpr("*", "1 as rank", "2 as set", "3 as y0")
    chain = toxicity.train(df, df.where("doc_id % 3 > 0"), {"insult": F.col("insult"), "threat": F.col("threat")}, bits=14)
    assert chain.categories == ["insult", "threat"] and len(chain.weights[1]) == len(chain.weights[0]) + 1
    assert chain.weights[1][1 << 14] > 0  # the second model listens to the first
    got = {r.doc_id: r for r in toxicity.classify(df, chain).collect()}
    held = [r for r in rows if r[0] % 3 == 0]
    for k, name, share in ((2, "insult", 0.85), (3, "threat", 0.7)):
        said = [(got[r[0]][name], bool(r[k])) for r in held]
        both = sum(a and b for a, b in said)
        assert both >= share * sum(a for a, _ in said) and both >= share * sum(b for _, b in said)
    again = toxicity.train(df.repartition(7), df.where("doc_id % 3 > 0"), {"insult": F.col("insult"), "threat": F.col("threat")}, bits=14)
    assert all((a == b).all() for a, b in zip(chain.weights, again.weights, strict=True))


def test_sample_is_bounded_and_weighted(spark):
    rows = table(random.Random(3), 2000)
    df = spark.createDataFrame(rows, "doc_id bigint, text string, insult int, threat int")
    sets, y, _, weight = toxicity.sample_labelled(df, df, {"insult": F.col("insult"), "threat": F.col("threat")}, 400, 12, "doc_id", "text")
    assert 300 < len(sets) < 500
    assert abs(weight.sum() / 2000 - 1) < 0.15 and y[:, 1].sum() > 0.6 * min(200, sum(r[3] for r in rows))


def test_odd_rows_and_nothing_to_learn(spark):
    labels = {"a": F.col("n_chars") * 0, "b": F.lit(None).cast("int")}
    df = documents(spark, [(None, "x y"), (2, None), (2, ""), (3, "y")])
    got = toxicity.classify(df, toxicity.train(df, df, labels, bits=8)).collect()
    assert len(got) == 4 and not any(r.a or r.b for r in got)
    empty = df.limit(0)
    chain = toxicity.train(empty, empty, labels, bits=8)
    assert toxicity.classify(empty, chain).count() == 0
    assert not any(r.a for r in toxicity.classify(df, chain).collect())


def test_repeated_ids_and_labels_are_weights(spark):
    rng = random.Random(3)
    texts = [(i % 40, " ".join(rng.choice(["good", "fine", "calm"] if i % 2 else ["vile", "foul", "calm"]) for _ in range(6)), "en", "s") for i in range(80)]
    df = documents(spark, texts * 3 + [(1, "good " * 200_000, "en", "s")])
    known = spark.createDataFrame([(i, i % 2, None if i % 5 == 0 else 1 - i % 2) for i in range(40)] * 4 + [(None, 1, 0), (7, None, None)], "doc_id bigint, quality int, toxic int")
    labels = {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}
    sets, y, rank, weight = toxicity.sample_labelled(df, known, labels, 1000, toxicity.BITS, "doc_id", "text")
    rows = {(i, t) for i, t, *_ in texts} | {(1, "good " * 200_000)}
    assert len(sets) == len(rows)  # each text of each id once
    assert weight.sum() == 4 * (3 * len(texts) + 1)  # for as many labels and rows as there are
    few = toxicity.sample_labelled(df, known, labels, 4, toxicity.BITS, "doc_id", "text")
    assert len(few[0]) < len(rows)
