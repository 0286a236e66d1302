"""Small tables of documents for tests."""

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, texts, lang="en", source="s"):
    """texts: (doc_id, text) or (doc_id, text, lang, source)."""
    rows = [(t[0], t[1], *(t[2:] if len(t) > 2 else (lang, source)), None if t[1] is None else len(t[1])) for t in texts]
    return spark.createDataFrame(rows, DOCS)


def words_of(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))
