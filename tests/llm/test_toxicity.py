import math
import random
import tempfile

from brute import edge_rows, empty, frame

from ledgerlens.llm import catalog, toxicity

LABELS = "doc_id long, quality int, toxic int"


def corpus(seed, n=240, first=0):
    rnd = random.Random(seed)
    docs, marks = [], []
    for i in range(first, first + n):
        w = [rnd.choice("abcdefghij") + rnd.choice("aeou") + rnd.choice("lmnrst") + rnd.choice(["", "el", "or"]) for _ in range(rnd.randint(5, 80))]
        bad = i % 4 == 0
        for _ in range(rnd.randint(1, 3) if bad else 0):
            w.insert(rnd.randrange(len(w) + 1), rnd.choice(["vilword", "zlurpen", "zlurpos", "zlurpat"]))
        docs.append((i, " ".join(w), None, None, None))
        marks.append((i, 1, int(bad)))
    return docs, marks


def test_learns_words_and_beginnings_and_finds_them_in_disguise(spark):
    docs, marks = corpus(1)
    sample = toxicity.training_sample(frame(spark, docs, clash=True), spark.createDataFrame(marks + [(None, 1, 1), (5, None, None)], LABELS), "doc_id % 5 <> 0")
    lexicon = toxicity.learn(sample)
    test, truth = corpus(2, first=1000)
    got = {r.doc_id: r.score >= 0.5 for r in toxicity.toxicity_scores(frame(spark, test), lexicon).collect()}
    assert sum(got[i] != bool(t) for i, _, t in truth) <= 2
    tricks = ["V1LW0RD", "vіlwоrd", "ｖｉｌｗｏｒｄ", "v!lw0rd", "VIL​WORD", "zlurpq", "vilword!!"]
    rows = [(i, f"bat cel dom {t} fun gat hel", None, None, None) for i, t in enumerate(tricks)] + [(100, "bat cel dom evilwords fun", None, None, None)]
    got = {r.doc_id: r.score >= 0.5 for r in toxicity.toxicity_scores(frame(spark, rows), lexicon).collect()}
    assert all(got[i] for i in range(len(tricks))) and not got[100]


def test_exception_phrases_hide_their_entry(spark):
    docs, marks = corpus(3)
    sample = toxicity.training_sample(frame(spark, docs), spark.createDataFrame(marks, LABELS), "true")
    lexicon = toxicity.learn(sample, exceptions=("vilword society",))
    rows = [(1, "the vilword society meets", None, None, None), (2, "the vilword meets society", None, None, None)]
    got = {r.doc_id: r.n_hits for r in toxicity.toxicity_scores(frame(spark, rows), lexicon).collect()}
    assert got == {1: 0, 2: 1}


def test_edge_rows_missing_labels_and_empty_tables(spark):
    docs, marks = corpus(4)
    none = spark.createDataFrame([], LABELS)
    for labels in (none, spark.createDataFrame([m for m in marks if m[2] == 0], LABELS)):
        lexicon = toxicity.learn(toxicity.training_sample(frame(spark, docs), labels, "true"))
        df = frame(spark, edge_rows(), clash=True)
        out = toxicity.toxicity_scores(df.drop("score"), lexicon).collect()
        assert len(out) == len(edge_rows()) and all(0 <= r.score < 0.5 for r in out)
        assert toxicity.without_toxic(df, lexicon).columns == df.columns
        assert toxicity.without_toxic(df, lexicon).count() == len(edge_rows())
        assert toxicity.toxicity_scores(empty(spark), lexicon).count() == 0


def test_fold():
    assert [w for w in toxicity.fold("Cl0wn! É1é  fоо_bar") if w] == ["clown", "élé", "foo", "bar"]


def test_harmless_phrases_and_longer_words_are_learned_from_clean_texts(spark, monkeypatch):
    docs, marks = corpus(6, n=1600)
    rnd = random.Random(7)
    for j, (i, t, *_) in enumerate(docs):
        if marks[j][2] == 0 and i % 80 in (1, 2, 3):
            w = t.split()
            at = rnd.randrange(len(w) + 1)
            w[at:at] = {1: ["photo", "vilword"], 2: ["vilword", "of", "honour"], 3: ["zlurpish"]}[i % 80]
            docs[j] = (i, " ".join(w), None, None, None)
    monkeypatch.setattr(catalog, "documents", lambda spark, sf_dir: frame(spark, docs))
    path = tempfile.mkdtemp(prefix="ledgerlens-test-")
    spark.createDataFrame(marks, LABELS).write.parquet(f"{path}/labels.parquet")
    lexicon = catalog.toxic_lexicon(spark, path)
    tests = ["the photo vilword here", "a vilword of honour now", "some zlurpish thing", "vilword here", "zlurpen now", "photo a vilword"]
    rows = [(i, t, None, None, None) for i, t in enumerate(tests)]
    got = {r.doc_id: (r.n_hits, r.score >= 0.5) for r in toxicity.toxicity_scores(frame(spark, rows), lexicon).collect()}
    assert got == {i: ((0, False) if i < 3 else (1, True)) for i in range(len(tests))}


def test_a_rare_toxic_word_behind_many_ordinary_ones(spark):
    """No entry is cut for being rarer than others: 60,000 words are more frequent in toxic texts."""
    words = [f"q{a}{b}{c}{d}" for a in "abcdefghjk" for b in "abcdefghjkmnprtuvwxyz" for c in "abcdefghjkmnprtu" for d in "abcdefghjkmnprtuvwx"][:60_000]
    docs, marks = [], []
    for i in range(24):
        part = words[:30_000] if i % 2 else words[30_000:]
        bad = i < 14
        text = list(part)
        if bad and i < 6:
            text[100 * (i + 1) : 100 * (i + 1)] = ["zuvvile"]
        docs.append((i, " ".join([f"text{i}", *text]), None, None, None))
        marks.append((i, 1, int(bad)))
    lexicon = toxicity.learn(toxicity.training_sample(frame(spark, docs), spark.createDataFrame(marks, LABELS), "true"))
    # the prefix "zuv" is as frequent, so either stands for the word
    assert any(" zuvvlle ".startswith(e.rstrip()) for e in lexicon.weights)
    got = toxicity.toxicity_scores(frame(spark, [(1, "a zuvvile b", None, None, None)]), lexicon).first()
    assert got.n_hits == 1


def plain_hits(lexicon, text):
    """Longest entry at each place, from left to right, by trying all entries."""
    table = {**lexicon.weights, **dict.fromkeys(lexicon.exceptions, 0.0)}
    text, at, found = toxicity.spaced(text), 0, []
    while at < len(text):
        here = [e for e in table if text.startswith(e, at)]
        if here:
            e = max(here, key=len)
            found += [table[e]] if table[e] else []
            at += len(e)
        else:
            at += 1
    return sum(found), len(found)


def test_hits_and_scores_equal_a_plain_longest_match(spark):
    docs, marks = corpus(8)
    lexicon = toxicity.learn(toxicity.training_sample(frame(spark, docs), spark.createDataFrame(marks, LABELS), "true"), exceptions=("vilword society", "zlurpen days"))
    test, _ = corpus(9)
    rnd = random.Random(1)
    rows = [(i, t.replace("vilword", rnd.choice(["vilword", "vilword society", "VILWORD"])).replace("zlurpen", rnd.choice(["zlurpen", "zlurpen days"])), None, None, None) for i, t, *_ in test]
    rows += [(9000 + j, r[1], None, None, None) for j, r in enumerate(edge_rows())]
    a, b, c = lexicon.curve
    for r in toxicity.toxicity_scores(frame(spark, rows), lexicon).collect():
        text = next(x[1] for x in rows if x[0] == r.doc_id)
        words = toxicity.words_of(text.encode()) if text else []
        weight, n = plain_hits(lexicon, words) if words else (0.0, 0)
        assert (r.n_hits, r.n_words) == (n, len(words)) and abs(r.hit_weight - weight) < 1e-9
        x, y = toxicity.features(weight, len(words))
        assert abs(r.score - 1 / (1 + math.exp(-min(50.0, max(-50.0, a + b * x + c * y))))) < 1e-12
