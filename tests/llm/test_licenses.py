import random
import time
from itertools import combinations

from metricloom.llm import licenses
from tests.llm.util import documents, words_of


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_rising_is_longest():
    rng = random.Random(4)
    for _ in range(200):
        p = rng.sample(range(30), rng.randrange(0, 9))
        got = licenses.rising(p)
        want = max((len(c) for n in range(len(p) + 1) for c in combinations(p, n) if list(c) == sorted(c)), default=0)
        assert len(got) == want and [p[i] for i in got] == sorted(p[i] for i in got)


def test_patience_aligns_equal_words_in_order():
    rng = random.Random(6)
    for _ in range(300):
        a = [rng.choice("abcdefghij") for _ in range(rng.randrange(0, 14))]
        b = [rng.choice("abcdefghij") for _ in range(rng.randrange(0, 14))]
        got = licenses.patience(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:], strict=False))
        assert len(got) <= lcs(a, b)
    distinct = rng.sample(range(100), 40)
    cut = [str(x) for x in distinct if rng.random() < 0.8]
    assert len(licenses.patience([str(x) for x in distinct], cut)) == len(cut)  # unique words: exact


def brute(text, least=0.8):
    """Licenses of which some stretch of the text has so much of the template, in order."""
    words, out = licenses._WORD.findall((text or "").lower()), set()
    for name, t in licenses.TEMPLATES.items():
        t = licenses._WORD.findall(t.lower())
        width = len(t) + len(t) // 4 + 2
        if any(lcs(t, words[i : i + width]) >= least * len(t) for i in range(max(1, len(words)))):
            out.add(name)
    return out


def test_planted_notices_are_found_and_clean_texts_are_not(spark):
    rng = random.Random(9)
    docs, want = [], {}
    short = [n for n, t in licenses.TEMPLATES.items() if len(t) < 90]
    for i in range(160):
        name = rng.choice(list(licenses.TEMPLATES)) if i % 2 else rng.choice(short)
        words = licenses.TEMPLATES[name].split()
        if len(words) > 20:
            for _ in range(3):
                words[rng.randrange(len(words))] = "xyz"
        notice = "\n".join([" ".join(words)] * rng.choice([1, 1, 3]))
        docs.append((i, f"{words_of(rng, rng.randrange(60))} {notice.upper() if i % 3 == 0 else notice}\n{words_of(rng, rng.randrange(60))}"))
        want[i] = name
    clean = [(1000 + i, words_of(rng, 200) + " the license of a public version under general use " + words_of(rng, 20)) for i in range(20)]
    odd = [(2000, None), (2001, ""), (2001, "İİ Released under the MIT License. é"), (None, "Licensed under CC BY-NC 4.0.")]
    df = documents(spark, docs + clean + odd).selectExpr("*", "'x' as license", "1 as matches")
    got = {}
    for r in licenses.find_licenses(df).collect():
        got.setdefault(r.doc_id, []).append(r.matches)
    for d, text in docs:
        (m,) = got[d]
        assert [x.license for x in m] == [want[d]] * len(m) and len(m) >= 1, (d, want[d], m)
        assert all(licenses._WORD.findall(text[x.start : x.end].lower())[0] in licenses._WORD.findall(licenses.TEMPLATES[want[d]].lower()) for x in m)
        assert want[d] in brute(text)
    repeated = [d for d, t in docs if t.lower().count(licenses.TEMPLATES[want[d]].lower()) == 3]
    assert repeated and all(len(got[d][0]) == 3 for d in repeated)
    assert all(got[d] == [[]] and not brute(t) for d, t in clean)
    assert got[2000] == [[]] and sorted(map(len, got[2001])) == [0, 1] and got[None][0][0].license == "CC-BY-NC-4.0"
    (m,) = [x for x in got[2001] if x]
    assert (m[0].start, m[0].end) == (3, 33)
    assert licenses.find_licenses(df.limit(0)).count() == 0
    assert [r.matches for r in licenses.find_licenses(documents(spark, docs[:1]), templates={}).collect()] == [[]]


def test_gaps_take_a_longest_common_subsequence():
    rng = random.Random(7)
    for _ in range(400):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(0, 12))] for _ in range(2))
        got = licenses._common(a, b, 0, len(a), 0, len(b))
        assert len(got) == lcs(a, b) and all(a[i] == b[j] for i, j in got)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:], strict=False))


def test_whole_licenses_and_repetitive_texts():
    templates = licenses.all_templates()
    scan = licenses.Scanner(templates, 0.8).scan
    rng = random.Random(8)
    for name in ("GPL-3.0-text", "Apache-2.0-text", "MPL-2.0-text"):
        words = templates[name].split()
        for _ in range(len(words) // 12):
            words[rng.randrange(len(words))] = "changed"
        found = scan(f"{words_of(rng, 300)} {' '.join(words)} {words_of(rng, 300)}")
        assert [x[0] for x in found] == [name] and found[0][3] >= 0.8
        assert not [x for x in scan(" ".join(templates[name].split()[: len(words) // 2])) if x[0] == name]
    began = time.process_time()
    scan("software " * 300_000)
    scrambled = templates["MIT-text"].split()
    rng.shuffle(scrambled)
    assert scan(" ".join(scrambled * 200)) == []
    assert time.process_time() - began < 60
