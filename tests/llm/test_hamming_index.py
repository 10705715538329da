import math
import random
import struct

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tradewind.llm import hamming_index as hi
from tradewind.llm.shared import shared_folder

SCHEMA = "vec_id long, embedding array<float>, label int, rows int, path string, dims string, asked int"


def single(x):
    return struct.unpack("f", struct.pack("f", x))[0]


def brute(rows, k, every):
    """Each query's k largest cosines; scores rounded, since sums in another order differ in the last bits."""
    vectors = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for q, a in vectors:
        if q % every == 0:
            found = [(-round(sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b)), 9), i) for i, b in vectors if i != q and len(b) == len(a)]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "p", "d", 2) for i, v in rows], SCHEMA).repartition(3)


def found(spark, rows, k=5, every=10, **options):
    got = hi.top_k(spark, frame(spark, rows), F.col("vec_id") % every == 0, shared_folder(spark, "hamming"), k=k, **options)
    return sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in got.collect())


@pytest.mark.parametrize("block_rows", [7, 16_384])
def test_widest_radius_is_exact(spark, monkeypatch, block_rows):
    monkeypatch.setattr(hi, "BLOCK_ROWS", block_rows)
    rng = random.Random(1)
    rows = [(i, [single(rng.gauss(0, 0.2)) for _ in range(6)]) for i in range(60)]
    rows += [(100 + i, rows[3][1]) for i in range(25)]  # one very common vector: ties
    rows += [(100, rows[3][1])] * 3 + [(120, rows[7][1]), (5, rows[9][1])]  # repeated ids and rows
    rows += [(200, None), (201, []), (210, []), (202, [None] * 6), (203, [float("nan")] * 6), (205, [float("inf")] + [0.0] * 5), (204, [1.0, 2.0])]
    rows += [(220, [single(0.3), -1.0]), (None, rows[0][1]), (230, [0.0] * 6), (231, [3e37] * 6), (240, [1.0])]
    assert found(spark, rows, bits=64, recall=1.0) == brute(rows, 5, 10)


def test_pigeonhole_finds_every_code_within_the_radius():
    rng = np.random.default_rng(2)
    vectors = np.vstack([rng.normal(size=(300, 12)), rng.normal(size=(8, 12)).repeat(20, axis=0) + rng.normal(scale=0.05, size=(160, 12))])
    model = hi.fit(vectors, 128)
    made = hi.block(np.arange(len(vectors)), hi.scaled(vectors), model, 5)
    index = hi.Index.__new__(hi.Index)
    keep, hi.load = hi.load, lambda _: made
    try:
        index.__init__("")
    finally:
        hi.load = keep
    bits = np.unpackbits(np.ascontiguousarray(index.codes).view(np.uint8), axis=1).astype(int)
    for radius in (0, 3, 7, 8, 20, 37, 64, 127, 128):
        for q in range(0, len(vectors), 13):
            apart = np.abs(bits - bits[q]).sum(axis=1)
            rows, distance = index.within(index.codes[q], radius)
            assert rows.tolist() == np.flatnonzero(apart <= radius).tolist() and distance.tolist() == apart[rows].tolist()
    assert all(sum(s + 1 for s in hi.shares(r, m)) == r + 1 for r in range(40) for m in (4, 8, 16))


def test_flips_and_present_values_agree(monkeypatch):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(400, 16))
    model = hi.fit(vectors, 64)
    made = hi.block(np.arange(400), hi.scaled(vectors), model, 5)
    monkeypatch.setattr(hi, "load", lambda _: dict(made))
    index = hi.Index("")
    few = [index.probed(c, 4).tolist() for c in index.codes[:50]]  # 17 flips a substring
    monkeypatch.setattr(hi, "flips", lambda radius: np.empty(1 << 20))
    assert [index.probed(c, 4).tolist() for c in index.codes[:50]] == few


def test_few_in_the_radius_are_asked_again(spark):
    """Pairs of near copies: the measured radius holds one neighbour, five are asked for."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 24))
    rows = [(2 * i + j, (b + rng.normal(scale=1e-3 * j, size=24)).astype(np.float32).tolist()) for i, b in enumerate(base) for j in range(2)]
    got = found(spark, rows, k=1, recall=0.5, every=2)
    assert got == brute(rows, 1, 2)
    assert len(found(spark, rows, k=5, recall=0.01, every=2)) == 60 * 5


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.1"])
def test_recall_on_the_given_vectors(spark, folder):
    path = f"/root/testdata/{folder}/embeddings.parquet"
    table = pq.read_table(path)
    ids, x = table["vec_id"].to_numpy(), np.stack(table["embedding"].to_numpy()).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    got = hi.top_k(spark, spark.read.parquet(path), F.col("vec_id") % 50 == 0, shared_folder(spark, "hamming")).collect()
    near = {}
    for r in got:
        near.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    asked = np.flatnonzero(ids % 50 == 0)
    for q in asked.tolist():
        cosine = x @ x[q]
        cosine[q] = -2
        hits += len(near[ids[q]] & set(ids[np.argsort(-cosine)[:5]].tolist()))
    assert sorted(near) == sorted(ids[asked].tolist()) and all(len(v) == 5 for v in near.values())
    assert hits >= 0.94 * 5 * len(asked)


def test_empty(spark):
    assert found(spark, [(1, None)]) == [] and found(spark, [(10, [1.0, 2.0])]) == []
    assert hi.top_k(spark, frame(spark, [(1, None)]).limit(0), F.col("vec_id") % 10 == 0, shared_folder(spark, "hamming")).collect() == []
