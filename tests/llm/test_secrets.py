"""The automaton against regular expressions, and odd rows."""

import hashlib
import random
import re
import time

from bankspark.llm.automaton import Matcher, compiled
from bankspark.llm.queries import QUERIES
from bankspark.llm.secrets import BASE, RULES, Scanner, find_secrets
from tests.conftest import DATA

PATTERNS = {
    "assign": (re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), lambda m: len(m[2]) >= 6),
    "access": (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    "hex": (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
}


def brute_force(text):
    found = [(m.start(), list(PATTERNS).index(k), m.end()) for k, (p, ok) in PATTERNS.items() for m in p.finditer(text or "") if ok(m)]
    return [(list(PATTERNS)[k], low, high) for low, k, high in sorted(found)]


def test_random_texts():
    rng = random.Random(5)
    parts = ["password", "PassWd", "token", "Secret", "api_key", "APIkey", "apikey", '"', "'", " ", "  ", ":", "=", "AKIA", "AKIAKIA",
             "ABCDEF0123456789", "deadbeef", "0123456789abcdef", "x", "a", "é", "中", "\n", ",", "-", "/", "zz", "ghp_", "Q"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(50))) for _ in range(4000)] + ["", "password=abcdef", "y" * 5000 + "token: abcdefg"]
    got = Scanner(RULES)([t.encode() for t in texts])
    for text, spans in zip(texts, got):
        points = [(k, len(text.encode()[:a].decode()), len(text.encode()[:b].decode())) for k, a, b in spans]
        assert [s for s in points if s[0] in BASE] == brute_force(text)


def test_extra_kinds_and_minimal_states():
    text = b"ghp_" + b"a1B2" * 9 + b", -----BEGIN RSA PRIVATE KEY-----\nAIza" + b"x" * 35
    assert [s[0] for s in Scanner(RULES)([text])[0]] == ["github", "pem", "google"]
    assert len(compiled(["ab|cb", "[ac]b"], anywhere=False).accepts) == 4
    assert list(Matcher("a{2,3}b?").spans(b"aaaab a aab")) == [(0, 3), (8, 11)]


def test_query_and_odd_rows(spark, documents, odd):
    rows = odd + [(40, "é token = abcdef1 " + "0f" * 12)]
    got = {(r.doc_id, tuple(map(tuple, r.spans))) for r in find_secrets(documents(rows)).collect()}
    assert got == {(i, tuple(brute_force(t))) for i, t in rows}
    assert find_secrets(documents([])).count() == 0
    folder = DATA.replace("0.001", "0.01")
    result = QUERIES["op4_secret_automaton"](spark, folder).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(folder + "/documents.parquet").collect()}
    assert len(result) == len(texts) and sum(r.n_assign + r.n_hex for r in result) > 5
    for r in result:
        want = brute_force(texts[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == b for k, *_ in want) for b in BASE)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()


def test_long_texts_that_look_like_keys():
    """Two megabytes each of starts that come to nothing and of one match, in seconds; spans as the patterns give them."""
    scanner = Scanner(RULES)
    texts = [b"eyJ" * 700_000, b"0123456789abcdef" * 130_000, b"password=" + b"x" * 2_000_000, b"-----BEGIN " * 190_000, b"xox" * 690_000]
    began = time.process_time()
    got = scanner(texts)
    assert time.process_time() - began < 25
    assert got[0] == [] and got[1] == [("hex", 0, 2_080_000)] and got[2] == [("assign", 0, 2_000_009)] and got[3] == [] and got[4] == []
    jwt = b"eyJ" * 1000 + b".eyJab.c " + b"eyJ.eyJa.b-c"
    assert list(Matcher(RULES[7].pattern).spans(jwt)) == [m.span() for m in re.finditer(RULES[7].pattern.encode(), jwt)]


def test_starts_are_those_of_all_matches():
    rng = random.Random(6)
    for rule in RULES:
        plain = re.compile(rule.pattern.encode())
        parts = [b"eyJ", b".", b"a", b"AKIA", b"Z9", b"-----BEGIN ", b"RSA ", b"PRIVATE KEY-----", b"xoxb-", b"ghp_", b"AIza", b"sk_live_", b"token", b" = ", b"'", b"ff"]
        matcher = Matcher(rule.pattern)
        for _ in range(200):
            data = b"".join(rng.choice(parts) for _ in range(rng.randrange(25)))
            assert list(matcher.spans(data)) == [m.span() for m in plain.finditer(data)]
            assert matcher.starts(data) == [k for k in range(len(data) - 1, -1, -1) if plain.match(data, k)]
