import random
import time

import numpy as np

from metricloom.llm import langid
from tests.llm.util import documents

WORDS = {"en": "the of and with ation ing er that this have".split(), "de": "der die und nicht schön ung keit über für".split(), "fr": "le la les été eau oui qui ment tion où".split()}


def table():
    rng = random.Random(5)
    rows = []
    for i in range(400):
        lang = rng.choice(list(WORDS))
        rows.append((i, " ".join("".join(rng.choice(WORDS[lang]) for _ in range(rng.randrange(1, 3))) for _ in range(rng.choice([1, 3, 20, 200]))), lang, "s"))
    return rows


def test_held_out_accuracy_and_rejects(spark):
    rows = table()
    df = documents(spark, rows + [(900, None, "en", "s"), (901, "12 %% 3", "en", "s"), (902, "", None, "s"), (903, "the of and", None, "s"), (None, "der die und", "de", "s")])
    model = langid.train(df.where("doc_id % 2 = 0 or doc_id is null"), per_lang=50)
    assert set(model.langs) == set(WORDS)
    got = {r.doc_id: r for r in langid.identify(df.selectExpr("*", "1 as score", "2 as lang_pred"), model).collect()}
    assert len(got) == len(rows) + 5
    odd = [r for r in rows if r[0] % 2]
    assert sum(got[d].lang_pred == c for d, _, c, _ in odd) >= 0.97 * len(odd)
    assert sum(got[d].rejected for d, *_ in odd) <= 0.01 * len(odd)
    for d in (900, 901, 902):
        assert (got[d].lang_pred, got[d].score, got[d].rejected) == ("und", 0.0, True)
    assert got[903].lang_pred == "en" and got[None].lang_pred == "de"
    assert all(0 <= r.score <= 1 for r in got.values())


def test_far_text_is_rejected_and_rows_kept(spark):
    df = documents(spark, table())
    model = langid.train(df, per_lang=50)
    junk = documents(spark, [(1, "zqxj" * 300, "en", "s"), (2, " ".join(["the of and with"] * 40), "xx", "s"), (2, " ".join(["the of and with"] * 40), "xx", "s")])
    kept = langid.keep_identified(junk, model)
    assert kept.columns == junk.columns and [r.doc_id for r in kept.collect()] == [2, 2]


def test_nothing_to_learn_from(spark):
    df = documents(spark, [(1, "abc", None, "s"), (2, None, "en", "s")])
    assert [(r.lang_pred, r.score) for r in langid.identify(df, langid.train(df)).collect()] == [("und", 0.0)] * 2
    assert langid.identify(df.limit(0), langid.train(df.limit(0))).count() == 0


def brute_vectors(texts, idf):
    return [langid.vector(langid.gram_counts(t), idf) for t in texts]


def test_prediction_is_the_nearest_of_all_centroids(spark):
    """Against plain cosines with every centroid, in blocks of one language and of all."""
    df = documents(spark, table())
    texts = [r[1] for r in table()]
    for block in (1, 128):
        model = langid.train(df, per_lang=20, centroids=3, block=block)
        rows = model.table.collect()
        got = {r.doc_id: r for r in langid.identify(df, model).collect()}
        for i, (at, v) in enumerate(brute_vectors(texts, model.idf)):
            near = max((float(v @ np.frombuffer(r.centroid, np.float32)[at]), r.lang) for r in rows)
            assert got[i].lang_pred == near[1] and abs(got[i].score - min(1, near[0])) < 1e-5


def test_frequencies_and_samples_cover_all_rows_and_languages(spark):
    same = [(None, "le la les et des eau qui", "fr", "s")] * 3000
    df = documents(spark, [*same, *((i, f"the of and with {i} ation ing", "en", "s") for i in range(300))])
    model = langid.train(df, per_lang=5)
    assert model.langs == ["en", "fr"] and {r.lang_pred for r in langid.identify(df, model).where("doc_id is null").collect()} == {"fr"}
    many = [(i, f"{chr(0x4E00 + i)}{chr(0x4E00 + i)} {chr(0x4E00 + i)}", f"l{i:03}", "s") for i in range(60)]
    df = documents(spark, many)
    got = langid.identify(df, langid.train(df, block=25)).collect()  # three passes
    assert all(r.lang_pred == f"l{r.doc_id:03}" and not r.rejected for r in got)


def test_letters_are_of_category_l_and_long_texts_are_whole():
    assert langid.gram_counts("² ½ Ⅷ ٣ _ 12") is None
    assert (langid.gram_counts("aⅧb½é") == langid.gram_counts("A B É")).all()
    one, n = langid.gram_counts("the of "), 400_000
    assert langid.gram_counts("the of " * n)[ord("t")] == n * one[ord("t")]


def test_a_letter_beyond_ascii_does_not_multiply_the_time():
    def seconds(text):
        runs = []
        for _ in range(5):
            start = time.process_time()
            langid.gram_counts(text)
            runs.append(time.process_time() - start)
        return min(runs)

    text = "the of and with " * 20_000
    assert seconds(f"{text}é") < 2.5 * seconds(f"{text}e")
