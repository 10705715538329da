import binascii
import math
import random
from collections import Counter

import numpy as np
import pytest

from tests.llm import cases
from tradewind.llm import elias_fano, ngram_trie
from tradewind.llm.shared import shared_folder


@pytest.mark.parametrize("n,universe", [(0, 10), (1, 1), (5, 2**64), (300, 400), (5000, 2**57), (200, 10**6)])
def test_elias_fano(n, universe, tmp_path):
    rng = random.Random(n)
    values = np.array(sorted(rng.randrange(universe) for _ in range(n)), np.uint64)
    path = elias_fano.write(str(tmp_path), "x", {"v": elias_fano.encode(values, universe)})
    coded = elias_fano.File(path).sequence("v")
    if n:
        assert (coded.get(np.arange(n)) == values).all()
    asked = np.array([rng.randrange(universe) for _ in range(500)] + values.tolist(), np.uint64)
    assert (coded.successor(asked) == np.searchsorted(values, asked)).all() if n else True
    found = coded.find(asked)
    assert all((i >= 0) == (v in set(values.tolist())) and (i < 0 or values[i] == v) for i, v in zip(found, asked.tolist()))


def test_scores_against_counters(spark):
    rows = cases.texts()
    docs = cases.documents(spark, rows, extra=True)
    trie = ngram_trie.train(spark, docs.where(~ngram_trie.held_out()), shared_folder(spark, "n"))
    got = ngram_trie.digest(ngram_trie.score(docs, trie), trie).collect()
    held = [i is not None and binascii.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    one, two = Counter(), Counter()
    for (_, t), h in zip(rows, held):
        if not h:
            w = [*cases.lower_words(t), ""]
            one.update(w)
            two.update(zip(["", *w], w))
    total, kinds = sum(one.values()), len(one)
    p1 = lambda w: (one[w] + 0.5) / (total + 0.5 * (kinds + 1))
    expected = []
    for (i, t), h in zip(rows, held):
        w = [*cases.lower_words(t), ""]
        base = sum(math.log10(p1(x)) for x in w)
        score = sum(math.log10((two[c, x] + ngram_trie.STRENGTH * p1(x)) / (one[c] + ngram_trie.STRENGTH)) for c, x in zip(["", *w], w))
        expected.append((i, h, len(w), sum(one[x] > 0 for x in w), total, base, score))
    key = lambda r: (r[0] is not None, r[0] or 0, *r[2:6])
    for g, e in zip(sorted(map(tuple, got), key=key), sorted(expected, key=key), strict=True):
        assert g[:5] == e[:5]
        assert g[5] == pytest.approx(e[5])
        assert abs(g[6] - e[6]) <= 0.07 * e[2]  # each probability is at most a step of 16 / 255 off, half of it in either part


def test_no_training_documents(spark):
    docs = cases.documents(spark, [(1, "a b"), (2, None)])
    trie = ngram_trie.train(spark, docs.limit(0), shared_folder(spark, "n"))
    got = {r["doc_id"]: r for r in ngram_trie.score(docs, trie).collect()}
    assert (got[1]["n_tokens"], got[1]["n_known"], got[2]["n_tokens"]) == (3, 0, 1)
    assert got[1]["score"] == pytest.approx(got[1]["base_score"])
    assert ngram_trie.score(docs.limit(0), trie).collect() == []
