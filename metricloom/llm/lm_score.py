"""Language-model scores from a subword lattice (operator 1).

A word's lattice has the pieces of an existing vocabulary, whose scores weight all segmentations: the forward
recursion in log space sums over all of them (``lattice.py``). The vocabularies at hand are byte-pair models, whose
scores are ranks; one expectation over the distinct training words (``rounds``; 0: the ranks alone) turns them into
unigram scores, which are normalised and then fixed. A word seen in
training is one more edge of its own lattice: it takes its discounted count, and the pieces have the
discounted rest (absolute discounting), so unseen words are spelled. Counts are kept by class of document (by
default its language); a text's probability is the sum over classes of the class's share times the product over
words and the end, so no class has to be known to score a text. The probabilities of all texts, as sequences of
words, sum to 1. ``lattice_score`` is what the vocabulary alone gives the text's words.

Scale: words are counted in each task before they are shuffled; the table of distinct words with their
scores is distributed and as large as the corpus makes it. Texts read it in two ways: at most ``HEAD`` words, all
those from a count on that a histogram of counts yields, are broadcast (words of over HEAD_BYTES bytes by
digest), so that no frequent word is shuffled; all other words of a text go through a join with the table. Both
together are exact.

Rows: a null text is the empty text (one end). Repeated rows and ids, null ids and null classes count like
any others; a null id is scored as training text with crc32 of nothing. Words of any length and very long texts
are scored whole, in memory that does not grow with a word's length times the pieces. Extra columns are ignored.
With no training text the base score is 0 and the score is the lattice's. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.llm.common import arrow_schema, blobs, ddl, documents, id_crc, release, slices, stored, words
from metricloom.llm.lattice import Lattice, load_pieces

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
HEAD, HEAD_BYTES, FLUSH, DISCOUNT = 1 << 17, 64, 400_000, 0.75


def _count(classes: list[str | None]):
    """Rows (doc text, class, is training) to rows (word, class place, training count, count), summed in the task."""
    place = {c: k for k, c in enumerate(classes)}
    names = ["word", "k", "c", "a"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (k, train), counter in held.items():
                n = pa.array(counter.values(), pa.int64())
                zero = pa.array(np.zeros(len(counter), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(counter, pa.binary()), pa.array(np.full(len(counter), k, np.int32)), n if train else zero, n], names=names)
            held.clear()

        for batch in slices(batches):
            for blob, c, train in zip(blobs(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                held.setdefault((place.get(c, len(classes)), train), Counter()).update(words(blob))
                if sum(map(len, held.values())) > FLUSH:
                    yield from out()
        yield from out()

    return run


def _key(word: bytes) -> bytes:
    """A frequent word as it is broadcast; no word begins with a space."""
    return word if len(word) <= HEAD_BYTES else b" " + hashlib.md5(word).digest()


def _expect(lattice):
    """Distinct words to (piece, expected uses)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(lattice.value.pieces))
        for batch in batches:
            total += lattice.value.expected(batch.column(0).to_pylist())
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["piece", "uses"])

    return run


def unigram_scores(lattice: Lattice, words: DataFrame, rounds: int) -> Lattice:
    """The lattice with its pieces weighted by their expected uses in ``words(word)``. A round's result has a number
    for each piece: as large as the vocabulary, not the corpus."""
    sc = words.sparkSession.sparkContext
    n = words.count() if rounds else 0
    for _ in range(rounds if n else 0):
        now = sc.broadcast(lattice)
        uses = words.mapInArrow(_expect(now), "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).toArrow()
        total = np.full(len(lattice.pieces), 0.01)
        total[uses["piece"].to_numpy()] += uses["uses"].to_numpy()
        inner = total[len(lattice.opening) :].sum()
        lattice = Lattice(list(zip(lattice.pieces, total.tolist(), strict=True)), n / (n + inner))
        now.unpersist()
    return lattice


def _spell(lattice):
    """Rows (word, ...) with the lattice's log probability of the word behind the same columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spelled = pa.array(lattice.value.log_probabilities(batch.column(0).to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, spelled], names=[*batch.schema.names, "spelled"])

    return run


def _score_head(head, k: int, schema):
    """Texts to what the head's words give, and the list of their other words."""
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, logs = head.value
        for batch in slices(batches):
            n, sums, tails = [], np.zeros((batch.num_rows, 3 + k)), []
            for i, blob in enumerate(blobs(batch.column(1))):
                w = words(blob)
                n.append(len(w) + 1)
                at, times, tail = [], [], []
                for x, tf in Counter(w).items():
                    if (j := place.get(_key(x))) is None:
                        tail.append({"word": x, "tf": tf})
                    else:
                        at.append(j)
                        times.append(tf)
                sums[i] = np.array(times, float) @ logs[at]
                tails.append(tail)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), *map(pa.array, sums.T), pa.array(tails, out.field("tail").type)], schema=out)

    return run


def _from_count(words: DataFrame, most: int) -> int:
    """The least step of the counts' histogram (eight steps to a doubling) such that at most ``most`` words are at it or above."""
    steps = words.groupBy(_step().alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 8 x 64 rows
    least, total = 1 << 10, 0
    for r in sorted(steps, key=lambda r: -r.step):
        total += r.n
        if total > most:
            break
        least = r.step
    return least


def _step():
    return F.floor(F.log2(F.col("a").cast("double")) * 8).cast("int")


def score_documents(
    df: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text", class_col: str | None = "lang", held_out: int = 10, classes: int = 16, stop: float = 0.5, rounds: int = 1
) -> DataFrame:
    """One row for each row of ``df``: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``,
    ``score`` and ``lattice_score``, these three log10. Trains on rows whose crc32(id) mod ``held_out`` is not 0; the
    most frequent ``classes`` values of ``class_col`` are classes and all other values are one more. ``vocabulary`` is
    a sentencepiece model, ``stop`` the probability that a word ends after a piece (learned by ``rounds``)."""
    spark = df.sparkSession
    pieces = load_pieces(vocabulary)
    class_of = F.col(class_col).cast("string") if class_col else F.lit(None).cast("string")
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), class_of.alias("cls"), (id_crc(F.col(id_col)) % held_out != 0).alias("train"))
    shares = docs.where("train").groupBy("cls").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "cls")
    top = [(r.cls, r.n) for r in shares.limit(classes).collect()]
    n_docs = docs.where("train").count()
    names = [c for c, _ in top]
    in_class = [n for _, n in top] + [n_docs - sum(n for _, n in top)]
    k = len(in_class)

    rows = docs.select("text", "cls", "train").mapInArrow(_count(names), "word binary, k int, c bigint, a bigint")
    by_class = [F.sum(F.when(F.col("k") == i, F.col("c")).otherwise(0)).alias(f"c{i}") for i in range(k)]
    counts = stored(rows.groupBy("word").agg(F.sum("c").alias("c"), F.sum("a").alias("a"), *by_class), "counts")
    seen = counts.agg(F.sum("c"), F.count(F.when(F.col("c") > 0, 1)), *[x for i in range(k) for x in (F.sum(f"c{i}"), F.count(F.when(F.col(f"c{i}") > 0, 1)))]).first()
    total, distinct = (seen[0] or 0) + n_docs, seen[1] + (n_docs > 0)
    size, types = [(seen[2 + 2 * i] or 0) + in_class[i] for i in range(k)], [seen[3 + 2 * i] for i in range(k)]

    lattice = spark.sparkContext.broadcast(unigram_scores(Lattice(pieces, stop), counts.where("c > 0").select("word"), rounds))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in counts.schema)
    base = lambda c: F.log10((c + 0.1) / (total + 0.1 * (distinct + 1)))

    def log_in(i: int):
        """log of the word's probability in a class: its discounted count, or the discounts times its spelling."""
        if not size[i]:
            return F.col("spelled") + math.log(0.5)
        rest = F.exp(F.col("spelled")) * (DISCOUNT * types[i])
        seen = F.greatest(F.col(f"c{i}") - DISCOUNT, F.lit(0.0))
        spelled = F.col("spelled") + (math.log(DISCOUNT * types[i] / size[i]) if types[i] else math.log(1e-300))
        return F.when(seen > 0, F.log((seen + rest) / size[i])).otherwise(spelled)

    sums = ["known", "base", "spelled", *(f"l{i}" for i in range(k))]
    spelled = counts.mapInArrow(_spell(lattice), f"{fields}, spelled double")
    scored = stored(spelled.select("word", "a", (F.col("c") > 0).cast("double").alias("known"), base(F.col("c")).alias("base"), "spelled", *(log_in(i).alias(f"l{i}") for i in range(k))), "words")
    release(counts)
    short = F.when(F.length("word") <= HEAD_BYTES, F.col("word")).otherwise(F.concat(F.lit(b" "), F.unhex(F.md5("word"))))
    top_words = scored.where(_step() >= _from_count(scored, HEAD)).select(short.alias("word"), *sums).toArrow()  # HEAD rows of bounded size at most
    head = spark.sparkContext.broadcast(({w: j for j, w in enumerate(top_words["word"].to_pylist())}, np.column_stack([top_words[x].to_numpy() for x in sums])))

    schema = ddl("doc_id string, row bigint, n bigint, " + ", ".join(f"{x} double" for x in sums) + ", tail array<struct<word:binary,tf:bigint>>")
    schema.fields[0] = df.select(F.col(id_col).alias("doc_id")).schema[0]
    heads = stored(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")).mapInArrow(_score_head(head, k, schema), schema), "heads")
    tails = heads.select("row", F.explode("tail").alias("t")).select("row", "t.word", "t.tf")
    tailed = tails.join(scored.drop("a"), "word").groupBy("row").agg(*(F.sum(F.col(x) * F.col("tf")).alias(f"t_{x}") for x in sums))
    whole = heads.drop("tail").join(tailed, "row", "left").select("doc_id", "n", *((F.col(x) + F.coalesce(f"t_{x}", F.lit(0.0))).alias(x) for x in sums))

    parts = [F.col(f"l{i}") + math.log((in_class[i] + 0.5) / (n_docs + 0.5 * k)) + math.log((in_class[i] / size[i] if in_class[i] else 1e-12) if size[i] else 0.5) for i in range(k)]
    most = F.greatest(*parts) if k > 1 else parts[0]
    score = (most + F.log(sum((F.exp(x - most) for x in parts), F.lit(0.0)))) / math.log(10)
    return whole.select(
        F.col("doc_id").alias(id_col), (id_crc(F.col("doc_id")) % held_out == 0).alias("held_out"), F.col("n").alias("n_tokens"),
        (F.round("known") + (1 if n_docs else 0)).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + base(F.lit(n_docs))).alias("base_score"), score.alias("score"), (F.col("spelled") / math.log(10)).alias("lattice_score"),
    )


def op1_lattice_score(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    return score_documents(documents(spark, sf_dir), vocabulary)
