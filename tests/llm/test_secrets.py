import hashlib
import random
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from metricloom.llm.automaton import compile_rules
from metricloom.llm.secrets import MORE, RULES, Rule, Scanner, compiled, find_secrets, redact_secrets, scanner
from tests.llm.util import documents

BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 24),
}
BITS = ["token", "Secret", "api_key", "APIKEY", "passWord", "passwd", "=", ":", " ", '"', "'", "abc", "AKIA", "ABCDEF0123", "0123456789abcdef", "deadbeef", "-", "é", "ſecret", "\n", "ghp_", "a" * 40]


def brute(text):
    kinds = list(BASE)
    return sorted(((m.start(), kinds.index(k), m.end()) for k, (p, g, n) in BASE.items() for m in p.finditer(text) if len(m[g]) >= n))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(BITS), max_size=14))
def test_scanner_matches_re(parts):
    data = "".join(parts).encode()
    text = data.decode("latin-1")
    assert [(s, k, e) for k, s, e in scanner(compiled(RULES)).scan(data) if k < 3] == brute(text)


def test_long_texts_of_one_rule_take_linear_time():
    n = 1_000_000
    began = time.process_time()
    assert [x for x in scanner(compiled(RULES)).scan(b"token=password: " + b"a" * n) if x[0] == 0] == [(0, 0, 14)]
    assert [x for x in scanner(compiled(RULES)).scan(b"token=" * (n // 6)) if x[0] == 0] == [(0, 0, 6 * (n // 6))]
    scanner(compiled(RULES)).scan(b"eyJ" * (n // 3))
    scanner(compiled(RULES)).scan(b"AKIAtoken:" * (n // 10))
    assert time.process_time() - began < 60  # seconds here; hours if every end walked back


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=12))
def test_automaton_says_where_rules_end(text):
    patterns = ["ab+", "(a|bc){2,3}", "c[^a]?b*", "a.c"]
    dfa = compile_rules([(p, False) for p in patterns])
    state = dfa.start
    for i, b in enumerate(text.encode(), 1):
        state = dfa.table[state][b]
        expected = sum(1 << k for k, p in enumerate(patterns) if any(re.fullmatch(p, text[j:i]) for j in range(i + 1)))
        assert dfa.accept[state] == expected


def test_more_rules_and_minimal_size():
    samples = {"github": "ghp_" + "a1B2" * 9, "slack": "xoxb-1234567890-abcdefghij", "google": "AIza" + "x" * 35, "jwt": "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.abc-_def", "private_key": "-----BEGIN RSA PRIVATE KEY-----"}
    for k, rule in enumerate(MORE, 3):
        text = f"x {samples[rule.kind]} y".encode()
        assert (k, 2, len(text) - 2) in scanner(compiled(RULES)).scan(text)
    assert len(compile_rules([("a|b", False)], anywhere=False).table) == len(compile_rules([("[ab]", False)], anywhere=False).table) == 3


def test_query_digests(spark, tmp_path):
    rng = random.Random(4)
    texts = [(i, "".join(rng.choice(BITS) for _ in range(rng.randrange(40)))) for i in range(120)] + [(500, None), (501, ""), (502, "é" * 9 + 'token = "abcdef1"'), (None, "secret: abcdefg"), (502, "x" * 300_000 + " passwd=longenough")]
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    from metricloom.llm.secrets import op10_secret_scan

    got = sorted((str(r.doc_id), r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in op10_secret_scan(spark, str(tmp_path)).collect())
    want = []
    for d, t in texts:
        found = brute(t or "")
        kinds = list(BASE)
        told = ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in found)
        want.append((str(d), *(sum(k == i for _, k, _ in found) for i in range(3)), hashlib.sha256(told.encode()).hexdigest()))
    assert got == sorted(want)


def test_redaction_keeps_rows_and_columns(spark):
    df = documents(spark, [(1, "a token = abcdef99 b"), (2, None), (3, "clean"), (1, "a token = abcdef99 b")]).selectExpr("*", "7 as spans")
    got = redact_secrets(df, length_col="n_chars")
    assert got.columns == df.columns
    assert sorted((r.doc_id, r.text or "", r.n_chars or -1) for r in got.collect()) == [(1, "a [secret] b", 12), (1, "a [secret] b", 12), (2, "", -1), (3, "clean", 5)]
    assert find_secrets(df.limit(0)).count() == 0
    assert find_secrets(df, (Rule("a", "a+"),)).count() == 4


@settings(max_examples=300, deadline=None)
@given(st.text("abc=", max_size=14))
def test_overlapping_rules_match_re(text):
    rules = {"x": "a(b|c)*=", "y": "(ab|b)=?c", "z": "[ab]+"}
    got = Scanner(compiled(tuple(Rule(k, p) for k, p in rules.items()))).scan(text.encode())
    want = sorted(((k, m.start(), m.end()) for k, p in enumerate(rules.values()) for m in re.finditer(p, text)), key=lambda x: (x[1], x[0]))
    assert got == want
