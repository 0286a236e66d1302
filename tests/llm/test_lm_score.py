import itertools
import math
import random
import re
import zlib

import pytest

from metricloom.llm import lm_score
from metricloom.llm.lattice import LONG, Lattice, load_pieces
from tests.llm.util import documents, words_of

PIECES = [(x, (k % 7 + 1) / 20) for k, x in enumerate([b"a", b"b", b"c", b" a", b"ab", b"bc", b"abc", b" ab", b"cab", b"aaaa", b" ", b" bca", "é".encode()])]


def brute(word, lattice, stop=0.5):
    """Sum over all segmentations by a plain recursion over probabilities (logarithms would round nothing here)."""
    opening = {x: math.exp(p) for x, p in lattice.opening.items()}
    inner = {x: math.exp(p) for x, p in lattice.inner.items()}
    reach = [0.0] * (len(word) + 1)
    scale = 0.0
    for end in range(len(word) + 1):
        now = opening.get(word[:end], 0.0) if scale == 0.0 else 0.0
        for k in range(max(0, end - 8), end):
            now += reach[k] * inner.get(word[k:end], 0.0)
        reach[end] = now
        if end > 20 and 0 < now < 1e-200:
            scale += math.log(1e200)
            for k in range(end - 9, end + 1):
                reach[k] *= 1e200
    return math.log(reach[-1]) - scale + math.log(stop)


def test_words_match_brute_force_at_every_length(monkeypatch):
    rng = random.Random(3)
    lattice = Lattice(PIECES)
    found = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 12))) for _ in range(80)] + ["éaÿ".encode(), b"\x00\xff"]
    found += [bytes(rng.choice(b"abc") for _ in range(n)) for n in (LONG - 1, LONG, LONG + 1, 2000, 600)] + [b"a" * 3000]
    want = [brute(w, lattice) for w in found]
    assert lattice.log_probabilities(found) == pytest.approx(want, rel=1e-9)
    monkeypatch.setattr("metricloom.llm.lattice.CHUNK", 5)
    assert [lattice.walk(w) for w in found] == pytest.approx(want, rel=1e-9)


def test_expected_uses_are_those_of_all_segmentations(monkeypatch):
    rng = random.Random(5)
    lattice = Lattice(PIECES)
    for w in [bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 9))) for _ in range(40)]:
        ways = []  # (log probability, pieces) of each segmentation

        def go(at, logp, used):
            if at == len(w):
                ways.append((logp, used))
            for x, p in lattice.inner.items():
                if w.startswith(x, at):
                    go(at + len(x), logp + p, [*used, x])

        for x, p in lattice.opening.items():
            if w.startswith(x):
                go(len(x), p, [b" " + x])
        whole = sum(math.exp(p) for p, _ in ways)
        want = dict.fromkeys(lattice.pieces, 0.0)
        for p, used in ways:
            for x in used:
                want[x] += math.exp(p) / whole
        assert dict(zip(lattice.pieces, lattice.expected([w]), strict=True)) == pytest.approx(want, abs=1e-9)
        monkeypatch.setattr("metricloom.llm.lattice.LONG", 0)
        monkeypatch.setattr("metricloom.llm.lattice.CHUNK", 3)
        assert dict(zip(lattice.pieces, lattice.expected([w]), strict=True)) == pytest.approx(want, abs=1e-9)
        monkeypatch.undo()


def test_masses_of_words_sum_to_one():
    lattice = Lattice([(x, w * 1e6) for x, w in PIECES if len(x.strip()) < 3], stop=0.6)  # other bytes weigh next to nothing
    rows = [sum(math.exp(p) for p in lattice.log_probabilities([bytes(w) for w in itertools.product(b"abc", repeat=n)])) for n in range(1, 9)]
    two = sum(math.exp(p) for p in lattice.log_probabilities(["é".encode()]))
    assert all(0 < x < 1 for x in rows) and sum(rows) + two <= 1 + 1e-9
    tiny = Lattice([(b" a", 1.0), (b"a", 1.0)])
    weight = 1 / (1 + 1)  # of " a", the space alone weighs as much
    assert math.exp(tiny.log_probabilities([b"a"])[0]) == pytest.approx(weight * 0.5 + weight * 0.5 * math.exp(tiny.inner[b"a"]) / 0.5, rel=1e-9)
    every = sum(math.exp(p) for p in Lattice([(b" a", 1.0), (b"a", 1e9)]).log_probabilities([b"a" * n for n in range(1, 60)]))
    assert 0.4 < every <= 1


def test_vocabulary_opens_and_goes_on():
    pieces = load_pieces(lm_score.VOCABULARY)
    assert len(dict(pieces)) == len(pieces) and all(w > 0 for _, w in pieces)
    lattice = Lattice(pieces)
    assert sum(math.exp(p) for p in lattice.inner.values()) == pytest.approx(0.5)
    assert all(b" " not in x for x in lattice.inner) and all(b" " not in x for x in lattice.opening)
    with pytest.raises(FileNotFoundError, match="vocabulary"):
        load_pieces("/nowhere.model")


def test_contract_columns_and_head_against_tail(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, words_of(rng, rng.randrange(30), 60).title(), rng.choice(["en", "fr", None])) for i in range(150)]
    rows += [(200, None, "en"), (201, "", "fr"), (7, "É é\x0b A b " + "x" * 2000, "en"), (7, rows[7][1], "en"), (None, "no id", "en")]
    df = documents(spark, [(*r, "s") for r in rows]).selectExpr("*", "1 as n", "2 as word")
    sort = lambda out: sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6), round(r.lattice_score, 6)) for r in out.collect())
    got = sort(lm_score.score_documents(df, rounds=0))
    crc = lambda d: zlib.crc32(b"" if d is None else str(d).encode())
    tokens = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + ["</s>"]
    count, by = {}, {}
    for d, t, c in rows:
        if crc(d) % 10:
            for w in tokens(t):
                count[w] = count.get(w, 0) + 1
                by.setdefault(c, {})[w] = by.setdefault(c, {}).get(w, 0) + 1
    total = sum(count.values())
    base = lambda w: math.log10((count.get(w, 0) + 0.1) / (total + 0.1 * (len(count) + 1)))
    lattice = Lattice(load_pieces(lm_score.VOCABULARY))
    spelled = {w: brute_of(lattice, w) for d, t, _ in rows for w in tokens(t)[:-1]}
    n_docs, k = sum(c["</s>"] for c in by.values()), len(by) + 1  # one more class for all other values

    def in_class(words, counts):
        size, types = sum(counts.values()), len(counts) - 1
        out = math.log((counts["</s>"] + 0.5) / (n_docs + 0.5 * k)) + math.log(counts["</s>"] / size)
        for w in words:
            seen = max(counts.get(w, 0) - 0.75, 0)
            out += math.log(seen + math.exp(spelled[w]) * 0.75 * types) - math.log(size) if seen else spelled[w] + math.log(0.75 * types / size)
        return out

    def score(words):
        parts = [in_class(words, c) for c in by.values()] + [sum(spelled[w] + math.log(0.5) for w in words) + math.log(0.5 / (n_docs + 0.5 * k)) + math.log(0.5)]
        most = max(parts)
        return (most + math.log(sum(math.exp(x - most) for x in parts))) / math.log(10)

    want = sorted((str(d), crc(d) % 10 == 0, len(tokens(t)), sum(w in count for w in tokens(t)), total, sum(map(base, tokens(t))), score(tokens(t)[:-1]), sum(spelled[w] for w in tokens(t)[:-1]) / math.log(10)) for d, t, _ in rows)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    for x, y in zip(got, want, strict=True):
        assert x[5:] == pytest.approx(y[5:], abs=2e-6)
    monkeypatch.setattr(lm_score, "HEAD", 5)  # nearly all words by the join
    monkeypatch.setattr(lm_score, "HEAD_BYTES", 2)
    monkeypatch.setattr(lm_score, "FLUSH", 20)
    assert sort(lm_score.score_documents(df, rounds=0)) == got
    assert lm_score.score_documents(df.limit(0)).count() == 0


def brute_of(lattice, word):
    """Plain recursion in log space over the pieces as they are written, from the word's end."""
    w = word.encode()
    tail = [-math.inf] * len(w) + [0.0]
    add = lambda xs: -math.inf if not (xs := [x for x in xs if x > -math.inf]) else max(xs) + math.log(sum(math.exp(x - max(xs)) for x in xs))
    for k in range(len(w) - 1, -1, -1):
        tail[k] = add([lattice.inner[w[k:e]] + tail[e] for e in range(k + 1, min(len(w), k + lattice.longest) + 1) if w[k:e] in lattice.inner])
    return add([p + tail[len(x)] for x, p in lattice.opening.items() if w.startswith(x)]) + lattice.stop
