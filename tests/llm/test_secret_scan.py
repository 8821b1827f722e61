import random
import re

from brute import edge_rows, empty, frame, key
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlens.llm import secret_scan

TEXTS = [
    'PassWord: "abc12345"  passwd=short token = secret=abcdefgh',
    "api_key='ABCDEFGH1' apikey:zzzzzzzz api key=abcdefgh",
    "AKIAABCDEFGHIJKL AKIASHORT xAKIA" + "A1" * 20,
    "deadbeef" * 4 + " " + "DEADBEEF" * 4 + " é" + "0" * 40,
    "-----BEGIN RSA PRIVATE KEY----- ghp_" + "a" * 36 + " https://u:hunter22@host/ tokeN:=x",
    "password: token: abcdefgh12",
]


def plain(text, rules):
    out = []
    for o, r in enumerate(rules):
        for m in re.compile(r.pattern, re.ASCII).finditer(text or ""):
            if len(m[r.group]) >= r.least:
                out.append((m.start(), o, m.end()))
    return [(rules[o].kind, s, e) for s, o, e in sorted(out)]


def test_equals_searching_every_text_with_every_rule(spark):
    rnd = random.Random(2)
    rows = edge_rows() + [(100 + i, "é ".join(rnd.sample(TEXTS, rnd.randint(0, 4))), None, None, None) for i in range(60)]
    rules = secret_scan.BASE_RULES + secret_scan.MORE_RULES
    out = secret_scan.scan_secrets(frame(spark, rows, clash=True)).collect()
    got = sorted(((r.doc_id, [tuple(s) for s in r.spans]) for r in out), key=key)
    assert got == sorted(((r[0], plain(r[1], rules)) for r in rows), key=key)
    assert any(r.spans for r in out)
    assert secret_scan.scan_secrets(empty(spark)).count() == 0


def test_base_spans():
    found = [plain(t, secret_scan.BASE_RULES) for t in TEXTS]
    assert found[0] == [("assign", 0, 19), ("assign", 35, 58)]
    assert [k for k, *_ in found[1]] == ["assign", "assign"]
    assert [k for k, *_ in found[2]] == ["access", "access"]
    assert [k for k, *_ in found[3]] == ["hex", "hex"]
    assert found[5] == []


def test_queries_of_known_patterns():
    assert secret_scan.trigram_query("abcd") == ("and", ("abc", "bcd"))
    assert secret_scan.trigram_query("[0-9a-f]+") == secret_scan.TRUE
    assert secret_scan.trigram_query("abc|x") == secret_scan.TRUE
    assert secret_scan.trigram_query("(abc|xyz)+q") == ("or", ("abc", "xyz"))
    assert secret_scan.trigrams(secret_scan.trigram_query("ab?cd[0-9]*efg")) == {"abc", "bcd", "acd", "efg"}


PATTERNS = ["(?:abc|abd)x*yzw", "a[bc]d(e|fg)?hij", "(foo|ba[rz])+[0-9]", "xy{2,3}zzz", *[r.pattern for r in secret_scan.BASE_RULES]]


@settings(max_examples=60, deadline=None)
@given(st.sampled_from(PATTERNS).flatmap(lambda p: st.tuples(st.just(p), st.from_regex(re.compile(p, re.ASCII), fullmatch=True))))
def test_every_match_satisfies_its_query(case):
    pattern, text = case
    query = secret_scan.trigram_query(pattern)
    postings = secret_scan.index_segment([text.encode("utf-8", "surrogatepass")], secret_scan.trigrams(query))
    assert len(secret_scan.candidates(query, postings, 1)) == 1


def test_index_equals_substring_search(monkeypatch):
    monkeypatch.setattr(secret_scan, "_CHUNK", 7)  # trigrams across chunk borders, texts over several chunks
    rnd = random.Random(8)
    texts = ["".join(rnd.choice("abcABC é\0") for _ in range(rnd.choice([0, 1, 2, 3, 5, 40]))).encode() for _ in range(80)]
    grams = {a + b + c for a in "abc" for b in "abc" for c in "abc"} | {"é a", "zzz"}
    got = secret_scan.index_segment(texts, grams)
    lower = [t.translate(secret_scan.LOWER) for t in texts]
    assert set(got) == grams
    for g in grams:
        # Beyond ASCII the first three bytes are looked up, which every text with the letters holds.
        assert got[g].tolist() == [i for i, t in enumerate(lower) if g.encode()[:3] in t]
    assert all(len(v) == 0 for v in secret_scan.index_segment([], grams).values())
    assert secret_scan.index_segment([b"abc"], set()) == {}


def test_one_very_long_text_among_many(spark):
    long = "x " * 700_000 + TEXTS[0] + " y" * 700_000 + TEXTS[2]
    rows = [(i, "plain words", None, None, None) for i in range(300)] + [(300, long, None, None, None), (301, TEXTS[0], None, None, None)]
    rules = secret_scan.BASE_RULES + secret_scan.MORE_RULES
    out = {r.doc_id: [tuple(s) for s in r.spans] for r in secret_scan.scan_secrets(frame(spark, rows)).collect()}
    assert out[300] == plain(long, rules) and out[301] == plain(TEXTS[0], rules) and len(out[300]) == 4
    assert all(out[i] == [] for i in range(300))
