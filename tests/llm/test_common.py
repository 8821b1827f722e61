import random

import numpy as np

from ledgerlens.llm import common


def test_word_hashes_do_not_depend_on_place_or_segment():
    rnd = random.Random(1)
    vocab = ["w%d" % i for i in range(500)] + ["é" * 3, "x" * 70_000, "\U0001f600"]
    words = [rnd.choice(vocab[:-2]) for _ in range(40_000)] + vocab
    rnd.shuffle(words)
    data = " \t".join(words).encode()
    table = common.word_table("blank")
    got = common.word_hashes(data, table)
    one = {w: common.word_hashes(w.encode(), table)[0] for w in set(words)}
    assert len(got) == len(words) and len(set(one.values())) == len(one)
    assert (got == np.array([one[w] for w in words])).all()


def test_gram_hashes_tell_order_and_length():
    w = common.word_hashes(b"a b c a b c b a", common.word_table("blank"))
    g = common.gram_hashes(w, 3)
    assert len(g) == 6 and g[0] == g[3] and len(set(g.tolist())) == 5
    assert len(common.gram_hashes(w, 9)) == 0
    assert common.gram_hashes(w[:2], 2)[0] != common.gram_hashes(w[:3], 3)[0]
