import hashlib
import random
import zlib

from metricloom.llm import spotsigs
from tests.llm.test_simhash import brute_roots
from tests.llm.util import documents, words_of

ANCHORS = set(spotsigs.ANCHORS)


def brute_spots(text):
    found = [w.strip(".,;:!?()[]{}\"'*#%&$|-_/<>=+`~") or w for w in (text or "").lower().split()]
    out = set()
    for i, w in [(-1, "^"), *enumerate(found)]:
        if i < 0 or w in ANCHORS or zlib.crc32(w.encode()) % 8 == 0:
            chain = [x for x in found[i + 1 :] if x not in ANCHORS][:2]
            if chain:
                out.add(" ".join([w, *chain]))
    if len(out) == 1 and any(w not in ANCHORS for w in found):
        return {" ".join(["^", *(w for w in found if w not in ANCHORS)])}
    return out or ({" ".join(["^", *found])} if found else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "und", "la"]) if rng.random() < 0.4 else f"w{rng.randrange(300)}" for _ in range(n))


def test_neighbours_match_brute_force(spark):
    rng = random.Random(3)
    texts = [prose(rng, rng.choice([1, 2, 5, 40, 300])) for _ in range(150)] + [None, "", "the of", "Ünï the çà, DÜRFEN!", "x" * 5000, " \n"]
    texts += texts[:10]
    rng.shuffle(texts)
    docs = [(7 * i, t) for i, t in enumerate(texts)]
    shuffled = docs[:]
    rng.shuffle(shuffled)
    df = documents(spark, shuffled).selectExpr("*", "1 as range", "'a' as fingerprint").repartition(5)
    for width in (1 << 10, 13, 1):
        got = {r.doc_id: r for r in spotsigs.with_neighbours(df, rows_a_range=width).collect()}
        assert len(got) == len(docs)
        for k, (d, t) in enumerate(docs):
            t, follows = t or "", docs[(k + 1) % len(docs)][1] or ""
            edited = t[: len(t) - len(t) // 4] + follows[: len(t) // 4]
            r = got[d]
            assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
            assert abs(r.near_edited - jaccard(brute_spots(t), brute_spots(edited))) < 1e-9
            assert abs(r.near_next - jaccard(brute_spots(t), brute_spots(follows))) < 1e-9
    by_text = {}
    for d, t in docs:
        by_text.setdefault(t or "", set()).add(got[d].fingerprint)
    assert all(len(x) == 1 for x in by_text.values())


def test_ties_null_ids_and_small_tables(spark):
    df = documents(spark, [(None, "a b the c"), (5, "the same text"), (5, "the same text"), (5, "another the one"), (None, None)])
    got = spotsigs.with_neighbours(df, rows_a_range=1).collect()
    assert sorted(str(r.doc_id) for r in got) == ["5", "5", "5", "None", "None"]
    one = spotsigs.with_neighbours(documents(spark, [(1, "alone is the text")])).collect()
    assert [(r.near_next, r.n_chars) for r in one] == [(1.0, 17)]
    assert spotsigs.with_neighbours(df.limit(0)).count() == 0


def test_likeness_prunes_without_losing(spark):
    rng = random.Random(8)
    make = spotsigs.Prints()
    texts = [words_of(rng, rng.randrange(1, 400)).replace("w1", "the ") for _ in range(30)]
    texts += [t[: int(len(t) * rng.uniform(0.6, 1))] for t in texts]
    sets = [make(t.encode()) for t in texts]
    for a in sets:
        for b in sets:
            want = jaccard(set(a.tolist()), set(b.tolist()))
            assert abs(spotsigs.likeness(a, b) - want) < 1e-9
            assert want < 0.8 or spotsigs.may_be_near(len(a), len(b), spotsigs.sketch(a), spotsigs.sketch(b), 0.8)
            assert abs(spotsigs.likeness(a, b, 0.8) - (want if want >= 0.8 else 0)) < 1e-9


def edited(rng, text, share):
    return " ".join(f"x{rng.randrange(999)}" if rng.random() < share else w for w in text.split())


def test_classes_match_brute_force(spark):
    rng = random.Random(21)
    texts = [prose(rng, rng.choice([3, 8, 30, 120])) for _ in range(50)]
    for base in (prose(rng, 200), prose(rng, 60), "the w1 of w2 und w3"):
        texts += [edited(rng, base, rng.uniform(0, 0.12)) for _ in range(40)]
    texts += [t + " " + prose(rng, 6) for t in texts[:30]] + texts[:15] + ["", None, " "]
    docs = [(3 * i + 1, t) for i, t in enumerate(texts)]
    rng.shuffle(docs)
    make = spotsigs.Prints()
    sets = {d: set(make((t or "").encode()).tolist()) for d, t in docs}
    ids = sorted(sets)
    want = brute_roots(ids, [(a, b) for a in ids for b in ids if a < b and jaccard(sets[a], sets[b]) >= 0.8])
    assert 40 < len(set(want.values())) < len(ids) - 60
    df = documents(spark, docs).selectExpr("*", "1 as key", "2 as class_id", "3 as n")
    for most in (1 << 22, 300):  # 300: cells are dealt to pairs of blocks
        got = spotsigs.spot_classes(df, most=most).collect()
        assert {r.doc_id: r.class_id for r in got} == want and len(got) == len(docs)
    assert spotsigs.spot_classes(df.limit(0)).count() == 0


def test_query_has_classes_by_its_own_rows(spark):
    """Repeated and null ids, equal rows, and texts without anchors that begin alike."""
    rng = random.Random(5)
    base = prose(rng, 150)
    rows = [(4, base), (4, base), (9, edited(rng, base, 0.01)), (4, prose(rng, 80)), (None, None), (None, ""), (None, "nil"), (2, base + " w1")]
    rows += [(20, "zz1 zz2 qq1 qq4"), (21, "zz1 zz2 qq5 qq6")]
    got = spotsigs.with_neighbours(documents(spark, rows), rows_a_range=2, least=0.8).collect()
    assert sorted((str(r.doc_id), r.n_chars, str(r.class_id)) for r in got) == sorted(
        (str(i), len(t or ""), str(2 if t and t.startswith(base[:100]) or i == 9 else i)) for i, t in rows
    )
    assert {r.class_id for r in spotsigs.with_neighbours(documents(spark, rows)).collect()} == {None}


def test_words_beyond_the_anchors_count():
    make = spotsigs.Prints()
    table = " ".join(f"v{k}" for k in range(400))
    other = table.rsplit(" ", 100)[0] + " " + " ".join(f"u{k}" for k in range(100))
    assert len(make(table.encode())) > 20 and 0.4 < spotsigs.likeness(make(table.encode()), make(other.encode())) < 0.9


def test_forest_connects_what_pairs_do():
    rng = random.Random(2)
    import numpy as np

    for least in (0.5, 0.8, 1.0):
        base = [sorted(rng.sample(range(60), rng.randrange(5, 30))) for _ in range(8)]
        sets = [np.array(sorted({x if rng.random() > 0.1 else rng.randrange(60) for x in b}), np.uint32) for b in base * 6]
        near = [(i, j) for i in range(len(sets)) for j in range(i) if jaccard(set(sets[i].tolist()), set(sets[j].tolist())) >= least]
        found = spotsigs.set_forest(sets, least)
        assert brute_roots(range(len(sets)), found) == brute_roots(range(len(sets)), near)
        assert all(tuple(sorted(p, reverse=True)) in set(near) for p in found) and len(found) < len(sets)


def test_sketches_part_what_is_unlike_and_nothing_else():
    import numpy as np

    rng = np.random.default_rng(6)
    sets = []
    for n in (1, 3, 90, 130, 300, 700, 5000):
        base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        for share in (0, 0.05, 0.1, 0.3):
            kept = base[rng.random(n) >= share]
            sets.append(np.unique(np.append(kept, rng.integers(0, 1 << 63, rng.integers(0, 1 + n // 8), dtype=np.uint64))))
    for least in (0.3, 0.8, 1.0):
        parts = spotsigs.sketch_parts([len(x) for x in sets], [spotsigs.sketch(x) for x in sets], least)
        assert sorted(i for p in parts for i in p) == list(range(len(sets)))
        of = {i: k for k, p in enumerate(parts) for i in p}
        near = [(i, j) for i in range(len(sets)) for j in range(i) if jaccard(set(sets[i].tolist()), set(sets[j].tolist())) >= least]
        assert all(of[i] == of[j] for i, j in near)
        # bases of their own do not hang together
        assert least < 0.8 or all(i // 4 == j // 4 for p in parts for i in p for j in p if len(sets[i]) > 50)
    x = sets[-1]
    assert (spotsigs.folded(spotsigs.sketch(x), 16) == np.packbits(np.bincount((x & np.uint64(127)).astype(int), minlength=128) % 2 == 1)).all()


def shuffled(spark):
    """Bytes written to shuffles so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_sets_that_no_pair_needs_are_not_shuffled(spark, monkeypatch):
    """Also where joins are too large to broadcast."""
    rng = random.Random(3)
    texts = [words_of(rng, 900, 10**6) for _ in range(150)]
    docs = [*texts, f"{texts[0]} more", f"more {texts[1]}"]
    written, stored = {}, spotsigs.stored

    def counted(df, name):
        before = shuffled(spark)
        out = stored(df, name)
        written[name] = shuffled(spark) - before
        return out

    monkeypatch.setattr(spotsigs, "stored", counted)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r.doc_id: r.class_id for r in spotsigs.spot_classes(documents(spark, list(enumerate(docs)))).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {i: {150: 0, 151: 1}.get(i, i) for i in range(152)}
    make = spotsigs.Prints()
    assert 0 < written["in-pairs"] < sum(len(make(t.encode())) * 8 for t in texts) / 4


def test_marked_keeps_all_needed_and_few_others(spark):
    rng = random.Random(6)
    numbers = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(20_000)] + [-1, 0, 1, (1 << 63) - 1, -(1 << 63)]
    rows, needed = spark.createDataFrame([(x, "r") for x in numbers], "short long, other string"), set(rng.sample(numbers, 3000)) | set(numbers[-5:])
    got = spotsigs.marked(rows, spark.createDataFrame([(x,) for x in needed], "short long"))
    assert got.columns == rows.columns
    kept = [r.short for r in got.collect()]
    assert needed <= set(kept) and len(kept) == len(set(kept)) < len(needed) + 100
