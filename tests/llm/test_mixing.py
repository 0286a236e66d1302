import random
import re

import numpy as np
import pytest

from metricloom.llm import mixing
from tests.llm.util import documents


def brute_targets(sizes, weights=(1, 2, 3), most=3.0):
    """sizes: {source: words}."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        open_ = [s for s in names if s not in capped]
        level = (total - sum(most * sizes[s] for s in capped)) / max(1e-300, sum(weight[s] for s in open_))
        target = {s: most * sizes[s] if s in capped else level * weight[s] for s in names}
        above = [s for s in open_ if target[s] > most * sizes[s]]
        if not above:
            return target
        capped |= set(above)


def table():
    rng = random.Random(7)
    rows = []
    for i in range(700):
        source = rng.choice(["a", "b", "B", "é", "z", None, "tiny", "nil"])
        n = {"tiny": rng.randrange(2), "nil": 0}.get(source, min(300, int(rng.paretovariate(1.2) * 20)))
        rows.append((i, " ".join(["w"] * n) + rng.choice(["", " ", "\t\n"]), "en", source))
    return rows + [(None, "a b", "en", "a"), (5, None, "en", "a"), (5, "x y z", "en", "z"), (5, "x y z", "en", "z")]


@pytest.mark.parametrize("block", [1 << 14, 64])
def test_targets_and_balance(spark, block, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", block)
    rows = table()
    df = documents(spark, rows)
    got = mixing.mix_sources(df).collect()
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    target = brute_targets(sizes)
    by = {(r.source_size, round(r.target, 6)): [] for r in got}
    for r in got:
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r["size"]
        by[r.source_size, round(r.target, 6)].append(r)
    assert set(by) == {(sizes[s], round(target[s], 6)) for s in sizes}
    for (n, t), docs in by.items():
        rate = t / n if n else 0
        assert all(int(rate + 1e-9) <= r.copies <= np.ceil(rate - 1e-9) for r in docs)
        off = abs(sum(r.taken for r in docs) - t)
        assert off <= (max(2, 0.01 * t) if block > 64 else max(r["size"] for r in docs))  # the landing moves one document
        assert abs(sum(r.copies for r in docs) - rate * len(docs)) <= 0.05 * len(docs) + 4
    again = mixing.mix_sources(df.repartition(7)).collect()
    key = lambda r: (str(r.doc_id), r["size"], r.source_size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_flight_keeps_sums_and_expectations():
    rng = np.random.default_rng(1)
    p, size = rng.random(40), rng.integers(0, 30, 40)
    mean = np.zeros(40)
    for k in range(3000):
        q = mixing.flight(p, size, np.random.default_rng(k))
        assert ((q > 1e-9) & (q < 1 - 1e-9)).sum() <= 2
        assert abs(q.sum() - p.sum()) < 8 and abs((q * size).sum() - (p * size).sum()) < 1e-5
        mean += q
    assert np.abs(mean / 3000 - p).max() < 0.05


def test_empty_table_and_extra_columns(spark):
    df = documents(spark, [(1, "a b", "en", "x")]).selectExpr("*", "1 as size", "2 as taken", "3 as block")
    assert [tuple(r) for r in mixing.mix_sources(df).collect()] == [(1, 2, 2, 2.0, 1, 2)]
    assert mixing.mix_sources(df.limit(0)).count() == 0
