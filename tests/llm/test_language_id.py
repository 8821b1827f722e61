import random
import unicodedata

import numpy as np
from brute import edge_rows, empty, frame

from ledgerlens.llm import language_id

WORDS = {
    "aa": "walo wemi wuta wopi walemi wotapi".split(),
    "bb": "krosh krent krull krashel krondik krisp".split(),
    "cc": "день ночь река дорога".split(),
}


def text(rnd, lang, n=40):
    return " ".join(rnd.choice(WORDS[lang]) for _ in range(n)) + "."


def rows(seed, n=60):
    rnd = random.Random(seed)
    return [(i, text(rnd, lang), lang, None, None) for i, lang in ((i, rnd.choice(list(WORDS))) for i in range(n))]


def test_languages_and_spans_of_mixed_texts(spark):
    model = language_id.learn(frame(spark, rows(1) + edge_rows()[:5], clash=True))
    test = rows(2)
    out = {r.doc_id: r for r in language_id.identify_languages(frame(spark, test), model).collect()}
    assert all(out[r[0]].lang_pred == r[2] and out[r[0]].score == 1.0 for r in test)
    rnd = random.Random(3)
    a, b, c = text(rnd, "aa", 30), text(rnd, "bb", 50), text(rnd, "cc", 20)
    mixed = f"{a} {b} {c}"
    (r,) = language_id.identify_languages(frame(spark, [(1, mixed, None, None, None)]), model).collect()
    assert r.lang_pred == "bb"
    assert [s.lang for s in r.spans] == ["aa", "bb", "cc"]
    assert [mixed[s.start : s.end] for s in r.spans] == [x.rstrip(".") for x in (a, b, c)]


def test_edge_rows_and_empty_model(spark):
    model = language_id.learn(frame(spark, rows(1)))
    rs = edge_rows() + [(50, "12 34 .,!", None, None, None)]
    out = language_id.identify_languages(frame(spark, rs, clash=True), model).collect()
    assert len(out) == len(rs) and {r.lang_pred for r in out if r.doc_id in (1, 2, 3, 50)} == {"und"}
    assert all(r.lang_pred in model.languages for r in out if r.doc_id in (4, 5, 6, 7, 8))
    none = language_id.learn(empty(spark))
    assert {r.lang_pred for r in language_id.identify_languages(frame(spark, rs), none).collect()} == {"und"}
    assert language_id.identify_languages(empty(spark), model).count() == 0


def test_viterbi_equals_trying_all_paths():
    rnd = np.random.default_rng(1)
    for _ in range(200):
        n, k = int(rnd.integers(1, 7)), int(rnd.integers(1, 4))
        s = rnd.normal(0, 3, (n, k))
        best = max(np.ndindex(*[k] * n), key=lambda p: sum(s[i, x] for i, x in enumerate(p)) - 4 * sum(a != b for a, b in zip(p, p[1:], strict=False)))
        assert tuple(language_id.viterbi(s, 4.0)) == best


def test_segments_keep_the_text():
    t = "ab " * 60_000 + "x" * 70_000
    parts = list(language_id.segments(t))
    assert "".join(parts) == t and len(parts) > 1


def test_a_rare_language_beside_a_hot_one_of_its_script_is_found(spark):
    rnd = random.Random(4)
    train = [(i, text(rnd, "aa" if i % 1000 else "bb"), "aa" if i % 1000 else "bb", None, None) for i in range(2000)]
    train += [(3000 + i, text(rnd, "cc"), "cc", None, None) for i in range(5)]
    model = language_id.learn(frame(spark, train))
    test = [(i, text(rnd, lang), lang, None, None) for i, lang in enumerate(["aa", "bb", "cc"] * 5)]
    out = {r.doc_id: r for r in language_id.identify_languages(frame(spark, test), model).collect()}
    assert [(out[r[0]].lang_pred, out[r[0]].score) for r in test] == [(r[2], 1.0) for r in test]


def many(rnd, n=230):
    names = [f"l{i:03}" for i in range(n)]
    return {x: ["".join(rnd.choice("bcdfghklmnprstvw") + rnd.choice("aeiou") for _ in range(3)) for _ in range(8)] for x in names}


def test_all_of_many_languages_are_learned_and_told_apart(spark):
    rnd = random.Random(5)
    words = many(rnd)

    def say(lang, n=60):
        return " ".join(rnd.choice(words[lang]) for _ in range(n))

    train = [(i, say(x), x, None, None) for i, x in enumerate([*words, *list(words)[:200] * 2])]
    model = language_id.learn(frame(spark, train))
    assert model.languages == sorted(words)
    test = [(i, say(x), x, None, None) for i, x in enumerate(words)]
    out = {r.doc_id: r for r in language_id.identify_languages(frame(spark, test), model).collect()}
    assert [(out[r[0]].lang_pred, out[r[0]].score) for r in test] == [(r[2], 1.0) for r in test]
    mixed = f"{say('l005')} {say('l229')} {say('l100', 90)}"
    (r,) = language_id.identify_languages(frame(spark, [(1, mixed, None, None, None)]), model).collect()
    assert [s.lang for s in r.spans] == ["l005", "l229", "l100"] and r.lang_pred == "l100"


def test_scores_by_cell_equal_the_full_table(spark, monkeypatch):
    rnd = random.Random(6)
    train = frame(spark, rows(1))
    mixed = " ".join(text(rnd, rnd.choice(list(WORDS)), rnd.randint(1, 40)) for _ in range(60))
    table = language_id.script_table()
    dense = language_id.learn(train)
    monkeypatch.setattr(language_id, "DENSE", 1)
    few = language_id.learn(train)
    assert dense.scores.table is not None and few.scores.table is None
    want = language_id.label_text(mixed, 3, dense.scores, dense.allowed, table, 12.0)
    for kept in (1 << 24, 0):
        monkeypatch.setattr(language_id, "_KEPT", kept)
        got = language_id.label_text(mixed, 3, few.scores, few.allowed, table, 12.0)
        assert all((a == b).all() for a, b in zip(got, want, strict=True)) and len(set(got[2])) == 3


def test_best_path_over_blocks_equals_one_block():
    rnd = np.random.default_rng(2)
    for _ in range(100):
        n, k = int(rnd.integers(2, 60)), int(rnd.integers(2, 20))
        s = rnd.normal(0, 4, (n, k))
        cut = int(rnd.integers(1, n))
        assert (language_id.best_path(lambda: iter([s[:cut], s[cut:]]), 4.0) == language_id.viterbi(s, 4.0)).all()


def test_only_letters_and_marks_after_letters_make_words(spark):
    model = language_id.learn(frame(spark, rows(1)))
    loose = ["\U0001f600", "\u2764\ufe0f", "\u0301 \u0302\u0303", "1\ufe0f\u20e3", "\U0001f600\u0301\U0001f1e9\U0001f1ea", "\U000e0100", "\U0010fffd\ue000"]
    words = ["\U00010330\U00010331", "\U00020000\U00020001", "wa\u0301lo", "\u0301walo", "\U0001f600walo\U0001f600"]
    out = language_id.identify_languages(frame(spark, [(i, t, None, None, None) for i, t in enumerate(loose + words)]), model).collect()
    spans = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in out}
    assert all(r.lang_pred == "und" and r.score == 0.0 and not r.spans for r in out if r.doc_id < len(loose))
    assert [spans[len(loose) + i] for i in range(len(words))] == [[(0, 2)], [(0, 2)], [(0, 5)], [(1, 5)], [(1, 5)]]


def test_table_equals_the_categories():
    t = language_id.script_table()
    assert len(t) == 0x110000 and t[0x10330] == 1 and not t[0x1F600] and t[ord("a")] == 2
    text = "a\u0301\u0302 \u0301b\u0301 \u0301\u0302 c\U0001f600\u0301\u0915\u093f"
    at, _, starts, script = language_id.letters(text, t)
    want, word = [], False
    for i, c in enumerate(text):
        kind = unicodedata.category(c)[0]
        word = kind == "L" or (kind == "M" and word)
        want += [i] if word else []
    assert at.tolist() == want and script.tolist() == [2, 2, 2, 2, 2, 2, 8, 8] and len(starts) == 4
