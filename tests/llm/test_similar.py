import random

import numpy as np

import corpus_pipeline
from metricloom.llm import similar
from tests.llm.test_simhash import brute_print, brute_roots
from tests.llm.util import documents, words_of


def grams(text):
    w = (text or "").lower().split()
    return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def cases():
    rng = random.Random(31)
    docs = [words_of(rng, rng.choice([1, 4, 30, 120])) for _ in range(40)]
    for n in (120, 400, 400, 2000):
        base = words_of(rng, n).split()
        for _ in range(14):  # copies, at likeness 0.7 to 1 of one another
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + n // 50)):
                copy[rng.randrange(n)] = f"x{rng.randrange(999)}"
            docs.append(" ".join(copy))
    docs += docs[:8] + ["", None, "a b", "A b"]
    rng.shuffle(docs)
    return list(enumerate(docs))


def test_stage_finds_copies_of_likeness_08_that_simhash_keeps(spark, tmp_path):
    docs = cases()
    sets = {d: grams(t) for d, t in docs}
    ids = sorted(sets)
    near = [(a, b) for a in ids for b in ids if a < b and jaccard(sets[a], sets[b]) >= 0.8]
    want = set(brute_roots(ids, near).values())
    fps = {d: brute_print(t) for d, t in docs}
    assert sum((fps[a] ^ fps[b]).bit_count() > 3 for a, b in near) > 20
    documents(spark, docs).write.parquet(f"{tmp_path}/d")
    got = corpus_pipeline.drop_near_duplicates(spark, spark.read.parquet(f"{tmp_path}/d"), "").collect()
    assert sorted(r.doc_id for r in got) == sorted(want)


def test_stage_links_by_fingerprints_by_likeness_and_by_both(spark, tmp_path):
    rng = random.Random(8)
    again = f"{words_of(rng, 9)} " * 60
    long = words_of(rng, 400).split()
    like = lambda t, k: " ".join(f"x{i}" if i in range(5, 400, 400 // k) else w for i, w in enumerate(t))
    tail = words_of(rng, 12)
    docs = [(1, f"{again}{tail}"), (2, f"{again}{words_of(rng, 12)}"), (3, again)]  # one fingerprint or nearly, sets unlike
    docs += [(11, " ".join(long)), (12, like(long, 8)), (13, f"{words_of(rng, 3)} {like(long, 8)}")]  # alike sets
    base = words_of(rng, 300)
    docs += [(22, base), (21, f"{base} {base}"), (23, like(base.split(), 8)), (24, words_of(rng, 60))]
    docs += [(31, None), (None, ""), (32, f"{again}{tail}"), (33, words_of(rng, 60))]
    sets, fps = {d: grams(t) for d, t in docs}, {d: brute_print(t) for d, t in docs}
    ids = sorted(d for d, _ in docs if d is not None)
    near = {(a, b) for a in ids for b in ids if a < b and (fps[a] ^ fps[b]).bit_count() <= 3}
    alike = {(a, b) for a in ids for b in ids if a < b and jaccard(sets[a], sets[b]) >= 0.8}
    want = set(brute_roots(ids, near | alike).values())
    assert near - alike and alike - near
    assert want != set(brute_roots(ids, near).values()) and want != set(brute_roots(ids, alike).values())
    documents(spark, docs).write.parquet(f"{tmp_path}/d")
    got = corpus_pipeline.drop_near_duplicates(spark, spark.read.parquet(f"{tmp_path}/d"), "").collect()
    assert sorted(r.doc_id for r in got) == sorted(want)


def test_roots_of_keys_that_fingerprints_join(spark):
    rng = random.Random(4)
    keys, fps = range(60), range(100, 150)
    prints = sorted({(rng.choice(keys), rng.choice(fps)) for _ in range(35)} | {(k, 200 + k) for k in keys})
    key_links = [(rng.choice(keys), rng.choice(keys)) for _ in range(8)]
    fp_links = [(200 + rng.choice(keys), rng.choice(fps)) for _ in range(8)]
    tables = [spark.createDataFrame(x, "a long, b long") for x in (key_links, fp_links)]
    roots = similar.joined_roots(spark.createDataFrame(prints, "key long, fp long"), *map(similar.connected_components, tables))
    got = {k: k for k in keys} | {r.node: r.root for r in roots.collect()}
    want = brute_roots([*keys, *range(100, 260)], [*prints, *key_links, *fp_links])
    assert {(a, b) for a in keys for b in keys if got[a] == got[b]} == {(a, b) for a in keys for b in keys if want[a] == want[b]}
    assert len(set(got.values())) < 40


def test_forest_connects_what_pairs_do():
    sets = [np.array(sorted({hash(g) & 0xFFFFFFFF for g in grams(t)}), np.uint32) for _, t in cases() if t]
    near = [(i, j) for i in range(len(sets)) for j in range(i) if jaccard(set(sets[i].tolist()), set(sets[j].tolist())) >= 0.8]
    found = similar.forest(sets, 0.8)
    assert brute_roots(range(len(sets)), found) == brute_roots(range(len(sets)), near)
    assert all(tuple(sorted(p, reverse=True)) in set(near) for p in found)
