import random

import corpus_pipeline
from metricloom.llm import decontam, mixing, secrets
from tests.llm.test_langid import WORDS
from tests.llm.test_simhash import brute_print, brute_roots
from tests.llm.util import documents

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    rng = random.Random(12)
    prose = lambda lang, n: " ".join("".join(rng.choice(WORDS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    items = [(i, prose("en", 25)) for i in range(5)]
    docs = []
    for i in range(240):
        lang = rng.choice(list(WORDS))
        docs.append((i, prose(lang, rng.choice([30, 80, 200])), lang, rng.choice(["a", "a", "a", "b", "c", None])))
    docs += [(300 + i, f"{docs[i][1]}", *docs[i][2:]) for i in range(20)]  # exact copies
    docs += [(400 + i, f"{prose('en', 10)} {items[i % 5][1]} {prose('en', 10)}", "en", "b") for i in range(10)]
    docs += [(500 + i, f"{prose('en', 30)} password = hunter{i}secret {prose('en', 5)}", "en", "c") for i in range(5)]
    docs += [(600, None, "en", "a"), (601, "", "en", "a"), (602, "12 34 %%", None, "b"), (603, "zqxj" * 200, None, "a")]
    return items, docs


def test_stages_decide_and_keep_what_is_clean(spark, tmp_path):
    items, docs = corpus()
    documents(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    held, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        held = stage(spark, held, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert held.columns == COLUMNS
            held.write.parquet(f"{tmp_path}/s{k}")
            held = spark.read.parquet(f"{tmp_path}/s{k}")
        seen.append({r.doc_id: r for r in held.collect()})
    every = {d[0]: d for d in docs}
    assert set(every) - set(seen[0]) == {600, 601, 602, 603}
    assert all(r.lang == every[d][2] for d, r in seen[0].items() if len(every[d][1]) > 300)
    fps = {d: brute_print(every[d][1]) for d in seen[0]}
    ids = sorted(fps)
    roots = brute_roots(ids, [(a, b) for a in ids for b in ids if a < b and (fps[a] ^ fps[b]).bit_count() <= 3])
    assert set(seen[1]) == set(roots.values())
    assert set(seen[1]) - set(seen[2]) == {d for d in seen[1] if any(decontam.reduced(t) in decontam.reduced(every[d][1]) for _, t in items)} != set()
    assert set(seen[3]) == set(seen[2])
    scan = secrets.scanner(secrets.compiled(secrets.RULES)).scan
    assert not any(scan(r.text.encode()) for r in seen[3].values())
    assert all(r.n_chars == len(r.text) for r in seen[3].values())
    assert {d for d in seen[3] if "[secret]" in seen[3][d].text} == {d for d in seen[2] if d >= 500} != set()
    want = {r.doc_id: r for r in mixing.mix_sources(spark.read.parquet(f"{tmp_path}/s3")).collect() if r.copies}
    assert {d: (r.copies, r.taken, r.text) for d, r in seen[4].items()} == {d: (r.copies, r.taken, seen[3][d].text) for d, r in want.items()}
    assert sorted((r.doc_id, r.copies) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted((d, r.copies) for d, r in want.items())


def test_empty_table(spark, tmp_path):
    documents(spark, [(1, "a")]).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_mix_keeps_rows_with_repeated_and_null_ids(spark, tmp_path):
    rows = [(None, f"w {'x ' * k}", "en", "a") for k in range(30)] + [(7, "a b c", "en", "b")] * 9
    documents(spark, rows).write.parquet(f"{tmp_path}/d")
    df = spark.read.parquet(f"{tmp_path}/d")
    got = mixing.take_mix(df)
    assert got.columns == [*COLUMNS, "size", "copies", "taken"]
    assert got.agg({"taken": "sum"}).first()[0] == mixing.mix_sources(df).agg({"taken": "sum"}).first()[0]
