import re
import sys
from collections import Counter, defaultdict
from pathlib import Path
from zlib import crc32

import pytest
from brute import ALNUM_WORD, blank_words, components, lower

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402

from ledgerlens.llm import catalog, toxicity  # noqa: E402
from ledgerlens.llm.common import stage  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, f in corpus_pipeline.STAGES:
        after = stage(f(spark, docs, SF), name)
        out.append((docs, after))
        docs = after
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_filters_keep_all_columns_and_rows_as_they_are(steps):
    for before, after in steps[:4]:
        assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert after.exceptAll(before.distinct() if before is steps[3][0] else before).count() == 0 or before is steps[3][0]


def test_toxicity_stage_drops_what_the_lexicon_rejects(spark, steps):
    before, after = steps[0]
    lexicon = catalog.toxic_lexicon(spark, SF)
    automaton, (a, b1, b2) = lexicon.automaton(), lexicon.curve
    keep = []
    for d, t in rows(before):
        words = toxicity.words_of((t or "").encode())
        x, y = toxicity.features(toxicity.hits(automaton, words)[0], len(words))
        if a + b1 * x + b2 * y < 0:
            keep.append(d)
    assert sorted(keep) == sorted(d for d, _ in rows(after)) and len(keep) < len(rows(before))


def test_near_duplicate_stage_equals_all_pairs(steps):
    before, after = (rows(x) for x in steps[1])
    want = [d for (d, _), (n, c, _) in zip(before, components(before, 5, 80), strict=True) if n == 0 or d == c]
    assert sorted(want) == sorted(d for d, _ in after)


def test_decontamination_stage_equals_trying_all_windows(spark, steps):
    before, after = (rows(x) for x in steps[2])
    wins = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = re.findall(ALNUM_WORD, lower(r.text))
        wins |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()

    def clean(t):
        w = re.findall(ALNUM_WORD, lower(t))
        return not any(tuple(w[i : i + n]) in wins for n in {len(x) for x in wins} for i in range(len(w) - n + 1))

    assert sorted(d for d, t in before if clean(t)) == sorted(d for d, _ in after)


def test_mix_stays_within_budget_and_three_copies(steps):
    before, after = (rows(x) for x in steps[3])
    text = dict(before)
    copies = Counter(d for d, _ in after)
    assert max(copies.values()) <= 3 and set(copies) <= set(text)
    total = sum(len(blank_words(t)) for t in text.values())
    taken = sum(n * len(blank_words(text[d])) for d, n in copies.items())
    assert total - max(len(blank_words(t)) for t in text.values()) <= taken <= total


def test_shards_hold_every_row_of_the_mix(steps):
    before, after = steps[4]
    got, held = after.collect(), defaultdict(list)
    assert Counter((r.doc_id, r.text_crc32) for r in got) == Counter((d, crc32((t or "").encode())) for d, t in rows(before))
    for r in got:
        held[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in held.values())
    sizes = [len(held[s]) for s in range(24)]
    assert max(sizes) - min(sizes) <= 1


def test_run_gives_the_last_stage(spark, steps):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, steps[4][1].collect()))
