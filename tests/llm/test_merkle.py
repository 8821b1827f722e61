"""Document fingerprints: the tree, likeness and order against plain Python."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from ledgerlens.llm import merkle
from tests.llm import brute


def leaves(text):
    out = []
    for p in re.findall(r"[^.!?\n]{1,64}[.!?]*\n*|[.!?]+\n*|\n+", text):
        d = hashlib.md5(p.encode()).hexdigest()[:13]
        kind = "." if not p.endswith("\n") else ";" if p.endswith("\n\n") or d[0] in "01" else ","
        out.append(f"{d}{min(len(p), 99):02d}{kind}")
    return out


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def fingerprint(text):
    sections = [s for s in "".join(leaves(text)).split(";") if s]
    digests = [sha(",".join(sha(p) for p in s.split(",") if p))[:16] for s in sections]
    return sha(";".join(digests)) + ":" + ";".join(f"{d}={s}" for d, s in zip(digests, sections))


def likeness(a, b):
    x, y = leaves(a), leaves(b)
    size = lambda s: sum(int(v[13:15]) for v in set(s))
    total = size(x) + size(y)
    return 1.0 if x == y else 2 * size(set(x) & set(y)) / total if total else 0.0


def audited(rows):
    key = lambda r: (r[0] is None, -(r[0] or 0))
    ordered = sorted(rows, key=key)
    out = []
    for i, r in enumerate(ordered):
        t, nxt = r[1] or "", ordered[(i + 1) % len(ordered)][1] or ""
        half = len(t) // 2
        e = t[: len(t) - half] + nxt[:half]
        out.append((r[0], len(t), sha(e), fingerprint(t), fingerprint(e), likeness(t, e), likeness(t, nxt)))
    return sorted(out, key=brute.key)


def result(spark, rows, clash=False, **kw):
    return sorted((tuple(r) for r in merkle.edit_audit(brute.frame(spark, rows, clash), **kw).collect()), key=brute.key)


def sample(n, seed=1):
    rnd = random.Random(seed)
    words = "alpha beta gamma. delta! epsilon? zeta\n eta\n\n \U0001f600 naïve".split(" ")
    return [(i * 7, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 80))), "en", "a", 1) for i in range(n)]


def test_equals_plain_trees(spark):
    rows = sample(150)
    rnd = random.Random(3)
    rnd.shuffle(rows)
    want = audited(rows)
    assert result(spark, rows) == want
    # the same over many ranges, whose first rows follow the last of the range above
    assert result(spark, rows, range_rows=4) == want
    assert result(spark, rows, clash=True, range_rows=20) == want


def test_edge_rows(spark):
    # rows with equal ids have equal texts here, or the order within them would be by digest;
    # of the two rows without an id either may come first
    rows = [r for r in brute.edge_rows() if r != (None, None, None, None, None)]
    for size in (2, 1000):
        assert result(spark, rows, range_rows=size) == audited(rows)
    assert len(result(spark, brute.edge_rows(), range_rows=3)) == len(brute.edge_rows())
    assert result(spark, [(1, "only. one\n", "en", "a", 1)]) == audited([(1, "only. one\n")])
    assert merkle.edit_audit(brute.empty(spark)).collect() == []
    nulls = [(None, "x", None, None, None), (None, "x", None, None, None)]
    assert result(spark, nulls, range_rows=1) == audited(nulls)


def test_one_id_on_a_third_of_all_rows(spark):
    rows = sample(60) + [(77, "same. text\n", "en", "a", 1)] * 30
    assert result(spark, rows, range_rows=5) == audited(rows)


def test_roots_tell_equality_and_branches_locate_edits(spark):
    lines = [f"line {i} of a text. It has two sentences.\n" for i in range(60)]
    edited = list(lines)
    edited[17] = "line 17 was changed. It has two sentences.\n"
    edited.insert(40, "a new line.\n")
    df = spark.createDataFrame([("".join(lines), "".join(edited))], "a string, b string")
    df = merkle.fingerprints(merkle.fingerprints(df, "a", "fa"), "b", "fb")
    r = df.select(
        merkle.differing(F.col("fa"), F.col("fb")).alias("gone"),
        merkle.differing(F.col("fb"), F.col("fa")).alias("new"),
        merkle.differing(F.col("fa"), F.col("fa")).alias("same"),
        (merkle.root(F.col("fa")) == merkle.root(F.col("fb"))).alias("equal"),
        "fb",
    ).first()
    sections = [[p for p in s.split("=")[1].split(",") if p] for s in r.fb.split(":")[1].split(";")]
    assert not r.equal and r.same == [] and len(r.gone) == 1 and len(r.new) == 2
    place = {(i, j): n for n, (i, j) in enumerate((i, j) for i, s in enumerate(sections) for j in range(len(s)))}
    assert sorted(place[x.section, x.paragraph] for x in r.new) == [17, 40]


def test_extra_columns_are_kept(spark):
    df = merkle.fingerprints(brute.frame(spark, sample(5), clash=True))
    assert df.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and df.columns[-1] == "fingerprint"
    assert {r.fingerprint for r in df.collect()} == {fingerprint(r[1]) for r in sample(5)}
