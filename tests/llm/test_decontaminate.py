import random

import pytest

from tests.llm import cases
from tradewind.llm import decontaminate

ITEMS = "item_id long, text string, start int"


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        k = rng.randrange(len(out))
        how = rng.randrange(3)
        if how == 0:
            out[k] = rng.choice("abcdefg ")
        elif how == 1:
            del out[k]
        else:
            out.insert(k, rng.choice("abcdefg "))
    return "".join(out)


def distance(item, text):
    """Least edits from the item to any part of the text."""
    item, text = ([ord(c) for c in _even(x)] for x in (item, text))
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def _even(text):
    return "".join(" " if c in "\t\n\r\v\f" else c.lower() if c < "\x7f" else c for c in text)


def test_edit_search_is_exact():
    rng = random.Random(1)
    for _ in range(200):
        item = "".join(rng.choice("ab ") for _ in range(rng.randrange(1, 90)))
        text = "".join(rng.choice("ab ") for _ in range(rng.randrange(1, 120)))
        masks = decontaminate.Items([(0, item)])._masks(0, decontaminate.symbols(item))
        assert decontaminate.nearest_end(decontaminate.symbols(text).tolist(), masks, len(item))[0] == distance(item, text)


def test_planted_passages(spark):
    """All exact ones are found, at least nine in ten at the largest number of edits, and nothing else."""
    rng = random.Random(2)
    items = [(k, cases.words(rng, rng.randrange(12, 60))) for k in range(30)]
    rows, exact, near = [], set(), set()
    for i in range(240):
        k, item = rng.choice(items)
        if i % 4 == 0:
            rows.append((i, cases.words(rng, 80)))
        elif i % 4 == 1:
            rows.append((i, f"{cases.words(rng, 40)}\n{item.upper()} {cases.words(rng, 40)}"))
            exact.add((i, k))
        else:
            passage = edited(rng, item, int(decontaminate.SHARE * len(item)) if i % 4 == 2 else 2)
            rows.append((i, f"{cases.words(rng, 30)} {passage} {cases.words(rng, 30)}"))
            near.add((i, k))
    texts, kinds = dict(rows), dict(items)
    got = decontaminate.leaks(spark, cases.documents(spark, rows, extra=True), spark.createDataFrame([(*i, 1) for i in items], ITEMS)).collect()
    pairs = {(r["doc_id"], r["item_id"]): r for r in got}
    assert exact <= set(pairs)
    assert all(pairs[p]["edits"] == 0 for p in exact)
    assert len(near & set(pairs)) >= 0.9 * len(near)
    for (i, k), r in pairs.items():
        assert r["edits"] == distance(kinds[k], texts[i]) <= decontaminate.SHARE * len(kinds[k])
        passage = texts[i][r["start"] : r["end"]]
        assert distance(kinds[k], passage) == r["edits"]


@pytest.mark.parametrize("block", [5_000, 2])
def test_awkward_rows(spark, monkeypatch, block):
    """More items than fit a block take several passes."""
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", block)
    rows = cases.texts()
    target = dict(rows)[60]
    items = [(1, target), (2, None), (3, ""), (None, target), (5, target), (6, "ab"), (7, "é ü 中文 𝄞 é ü 中文 𝄞")]
    benchmark = spark.createDataFrame([(*i, 1) for i in items], ITEMS)
    got = decontaminate.leaks(spark, cases.documents(spark, rows), benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got if r["item_id"] in (1, None, 5)} == {(60, 1), (60, None), (60, 5)}
    assert {(r["doc_id"]) for r in got if r["item_id"] == 7} == {82}
    assert {r["item_id"] for r in got} <= {1, None, 5, 6, 7}
    kept = decontaminate.without_leaks(spark, cases.documents(spark, rows), benchmark)
    leaked = {r["doc_id"] for r in got}
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == sorted(str(i) for i, _ in rows if i not in leaked)
    assert decontaminate.leaks(spark, cases.documents(spark, rows), benchmark.limit(0)).collect() == []
    assert decontaminate.leaks(spark, cases.documents(spark, []), benchmark).collect() == []


@pytest.mark.parametrize("length", [80, 400, 1_500, 4_000])
@pytest.mark.parametrize("share", [0.05, 0.1])
def test_recall_at_every_length(length, share):
    """Nine in ten copies at the largest number of edits are found, and as near as brute force finds them."""
    rng = random.Random(length)
    items = [(k, cases.words(rng, length)[:length]) for k in range(20)]
    texts = [f"{cases.words(rng, 20)} {edited(rng, item, int(share * length))} {cases.words(rng, 20)}" for _, item in items] + [cases.words(rng, 200)]
    searched = decontaminate.Items(items, share)
    got = {(n, k): edits for n, k, edits, *_ in searched.search(texts)}
    assert set(got) <= {(k, k) for k in range(20)}
    assert len(got) >= 18
    if length <= 400:
        assert all(got[n, k] == distance(items[k][1], texts[n]) for n, k in got)
