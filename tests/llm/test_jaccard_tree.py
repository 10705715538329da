import random

import numpy as np
import pytest

from tests.llm import cases
from tradewind.llm import graph, jaccard_tree
from tradewind.llm.shared import shared_folder


def shingles(text):
    w = cases.lower_words(text)
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                parent[root(i)] = root(j)
    ids = {}
    for i, (doc_id, _) in enumerate(rows):
        ids.setdefault(root(i), []).append(doc_id)
    least = {r: min((x for x in v if x is not None), default=None) for r, v in ids.items()}
    return [(doc_id, len(sets[i]), least[root(i)]) for i, (doc_id, _) in enumerate(rows)]


@pytest.mark.parametrize("block", [4096, 5])
def test_against_all_pairs(spark, monkeypatch, block):
    """Blocks of five sets take the way across blocks."""
    monkeypatch.setattr(jaccard_tree, "BLOCK_SETS", block)
    rng = random.Random(8)
    rows = cases.texts()
    for family in range(3):  # chains: each is near the one before, the ends are not near each other
        w = [f"f{family}w{rng.randrange(10_000)}" for _ in range(120)]
        for i in range(12):
            w = w[4:] + [f"f{family}w{rng.randrange(10_000)}" for _ in range(4)]
            rows.append((1000 + 100 * family + (7 * i) % 12, " ".join(w)))
    got = jaccard_tree.groups(spark, cases.documents(spark, rows, extra=True), shared_folder(spark, "j")).collect()
    names = ["doc_id", "n_shingles", "component_id"]
    assert cases.by(got, *names) == cases.by([dict(zip(names, r)) for r in brute(rows)], *names)


def test_one_of_each_group_stays(spark):
    rows = cases.texts()
    docs = cases.documents(spark, rows)
    kept = jaccard_tree.one_of_each(spark, docs, shared_folder(spark, "j"))
    assert kept.columns == docs.columns
    expected = {(i, t) for (i, t), (_, _, c) in zip(rows, brute(rows)) if c == i or i is None}
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in kept.collect()))) == sorted(map(str, expected))


def test_no_documents(spark):
    assert jaccard_tree.groups(spark, cases.documents(spark, []), shared_folder(spark, "j")).collect() == []


def test_tree_walk_finds_every_group():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 300, dtype=np.uint64)
    sets = [np.unique(rng.choice(pool[k % 7 * 40 :][:45], 40)) for k in range(80)]
    near = lambda a, b: jaccard_tree.near(len(np.intersect1d(a, b)), len(a), len(b))
    links = jaccard_tree.tree_links(sets, [0] * 80, list(range(80)))
    assert all(near(sets[i], sets[j]) for i, j in links)
    group = list(range(80))
    for i, j in links:
        group = [group[i] if g == group[j] else g for g in group]
    assert all(group[i] == group[j] for i in range(80) for j in range(i) if near(sets[i], sets[j]))
    across = jaccard_tree.tree_links(sets, [k % 2 for k in range(80)], list(range(80)))
    assert all(i % 2 != j % 2 for i, j in across)


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (7, 8), (11, 11), (20, 30), (30, 20)]
    found = graph.components(spark.createDataFrame(edges, "a long, b long"), shared_folder(spark, "g")).collect()
    assert {tuple(r) for r in found} == {(i, 1) for i in range(1, 6)} | {(7, 7), (8, 7), (9, 7), (20, 20), (30, 20)}
