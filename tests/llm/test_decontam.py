import random

import numpy as np

from metricloom.llm import decontam
from tests.llm.util import documents


def brute(item, text):
    """Least edits between the item and any part of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != t)))
        row = new
    return min(row)


def edited(rng, text, k):
    for _ in range(k):
        i = rng.randrange(len(text))
        text = rng.choice([text[:i] + text[i + 1 :], text[:i] + rng.choice("xyz ") + text[i:], text[:i] + rng.choice("xyz") + text[i + 1 :]])
    return text


def fixture():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("aeoutrns") for _ in range(rng.randrange(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(rng.randrange(4, 40))) for i in range(25)] + [(90, None), (91, ""), (92, "!!"), (93, "ab cd"), (94, "Éé Ünï çà dürfen wir")]
    docs = [(i, prose(rng.randrange(0, 120))) for i in range(40)]
    for i in range(120):
        _, t = items[rng.randrange(25)]
        docs.append((100 + i, f"{prose(rng.randrange(20))} {edited(rng, t, rng.randrange(0, max(1, len(t) // 7)))}, {prose(rng.randrange(20))}"))
    docs += [(499, "for " * 900 + items[2][1] + " for" * 50), (500, None), (501, ""), (502, items[3][1].upper().replace(" ", "!! ")), (503, "x éé ünï ÇÀ-dürfen  WIR y"), (503, "zz ab cd"), (None, items[5][1])]
    return items, docs


def test_banded_distance_is_exact_within_its_band():
    rng = np.random.default_rng(2)
    for _ in range(300):
        item, region = rng.integers(0, 3, rng.integers(1, 12)), rng.integers(0, 3, rng.integers(1, 30))
        want = brute(list(item), list(region))
        got, end = decontam.banded_distance(item.astype(np.uint32), region.astype(np.uint32), 12)
        assert got == want and 0 <= end <= len(region)


def test_leaks_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(decontam, "_WINDOW", 200)
    items, docs = fixture()
    frame = spark.createDataFrame(items, "item_id bigint, text string")
    df = documents(spark, docs).selectExpr("*", "1 as leaks", "2 as item_id")
    q, want = 8, []
    for d, t in docs:
        low, hits = decontam.reduced(t), set()
        for i, x in items:
            x = decontam.reduced(x)
            if x and len(x) < q:
                if f" {x} " in f" {low} ":
                    hits.add(i)
            elif x and brute(x, low) <= max(0, min(int(0.1 * len(x)), len(x) // q - 1)):
                hits.add(i)
        want.append((str(d), tuple(sorted(hits))))
    for block in (4_000_000, 900):  # 900: several passes
        got = sorted((str(r.doc_id), tuple(sorted({x.item_id for x in r.leaks}))) for r in decontam.find_leaks(df, frame, block=block, least=1).collect())
        assert got == sorted(want)
        kept = decontam.drop_leaks(df, frame, block=block, least=1)
        assert kept.columns == df.columns
        assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(d for d, h in want if not h)
    assert sum(bool(h) for _, h in want) > 60


def test_spans_are_code_points_of_the_text(spark):
    item = "the quick brown fox jumps over"
    texts = ["--The QUICK,, brown (fox) jumps over-- the", "İİ the quick  brown fox jumps over", item]
    got = decontam.find_leaks(documents(spark, list(enumerate(texts))), spark.createDataFrame([(1, item)], "item_id bigint, text string")).collect()
    for r in got:
        assert [decontam.reduced(texts[r.doc_id][x.start : x.end]) for x in r.leaks] == [item]
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert [r.leaks for r in decontam.find_leaks(documents(spark, [(1, item)]), none).collect()] == [[]]
    assert decontam.find_leaks(documents(spark, [(1, "a")]).limit(0), none).count() == 0


def test_crowded_windows_and_short_items(monkeypatch):
    items, docs = fixture()
    items += [(200, "for " * 30 + "ever"), (201, "for for for for"), (202, "yes"), (203, "a")]
    texts = [decontam.reduced(t) for _, t in docs] + ["for " * 3000 + "ever", "yesterday a cat", "well yes a"]
    whole = decontam.Items(items, 8, 0.1)
    want = [whole.search(t) for t in texts]
    assert [whole.items[k][0] for k, *_ in want[-2]] == [203] and [whole.items[k][0] for k, *_ in want[-1]] == [202, 203]
    monkeypatch.setattr(decontam, "MEETINGS", 300)
    assert [{x[0] for x in found} for found in map(whole.search, texts)] == [{x[0] for x in found} for found in want]
    assert not [k for k in decontam.Items(items, 8, 0.1, least=8).items if len(k[1]) < 8]
