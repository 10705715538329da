import hashlib
import math
import random
import zlib
from collections import Counter

import pytest
import regex

from tests.llm import cases
from tradewind.llm import resampling
from tradewind.llm.shared import shared_folder

WORD = regex.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    spans = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(s.encode()) % 10000 for s in spans]


def brute(rows, target):
    found = [features(t) for _, t in rows]
    s, t = Counter(b for _, f in found for b in f), Counter(b for x in target for b in features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000))))
    out = []
    for (i, _), (n, f) in zip(rows, found, strict=True):
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        out.append([n, i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    order = sorted((r for r in out if r[0] >= 20), key=lambda r: (-r[4], r[1] is None, r[1] or 0, r[2], r[3]))
    drawn = 5 * len(order) // 100
    place = {id(r): k for k, r in enumerate(order, 1) if k <= drawn}
    return [(*r[1:], place.get(id(r))) for r in out]


def drawn(spark, docs, target):
    return [tuple(r) for r in resampling.draw(spark, docs, target, shared_folder(spark, "resampling")).collect()]


def ordered(rows):
    return sorted(rows, key=lambda r: [(x is not None, x or 0) for x in r])


@pytest.mark.parametrize("extra", [False, True])
def test_against_all_counts(spark, extra):
    rng = random.Random(2)
    rows = cases.texts() + [(300 + i, cases.words(rng, 25)) for i in range(60)] + [(400, "A-b_c9\x00d\x7fÉé~ﬀ x"), (401, "one"), (402, "one two"), (403, "—")]
    target = [rows[3][1], "the of and", None, "", rows[60][1]]
    items = spark.createDataFrame([(i, t, 1) for i, t in enumerate(target)], "item_id long, text string, bucket int")
    got = drawn(spark, cases.documents(spark, rows, extra), items)
    assert ordered(got) == ordered(brute(rows, target))
    assert sorted(r[4] for r in got if r[4]) == list(range(1, 1 + 5 * sum(features(t)[0] >= 20 for _, t in rows) // 100))


def test_ranks_go_on_over_partitions(spark):
    rng = random.Random(3)
    rows = [(i % 500, cases.words(rng, 20 + i % 3)) for i in range(1_000)]
    docs = cases.documents(spark, rows).repartition(16)
    assert ordered(drawn(spark, docs, docs.limit(0))) == ordered(brute(rows, []))


def test_empty(spark):
    docs = cases.documents(spark, [(1, None)])
    assert drawn(spark, docs.limit(0), docs) == []
    got = drawn(spark, docs, docs.limit(0))
    assert ordered(got) == brute([(1, None)], [])
