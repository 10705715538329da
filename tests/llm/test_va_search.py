import math
import random

import pytest
from pyspark.sql import functions as F

from tests.llm.cases import by
from tradewind.llm import va_search
from tradewind.llm.shared import shared_folder

SCHEMA = "vec_id long, embedding array<float>, label int, number int, path string"


def brute(rows, k, every):
    vectors = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in vectors:
        if q % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in vectors if i != q and len(b) == len(a))[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scores, 1)]
    return out


@pytest.mark.parametrize("block_rows", [7, 4096])
def test_against_all_products(spark, monkeypatch, block_rows):
    import struct

    monkeypatch.setattr(va_search, "BLOCK_ROWS", block_rows)
    single = lambda x: struct.unpack("f", struct.pack("f", x))[0]
    rng = random.Random(1)
    rows = [(i, [single(rng.gauss(0, 0.2)) for _ in range(6)]) for i in range(60)]
    rows += [(100 + i, rows[3][1]) for i in range(30)]  # one very common vector: ties
    rows += [(200, None), (201, []), (210, []), (202, [None] * 6), (203, [float("nan")] * 6), (205, [float("inf")] + [0.0] * 5), (204, [1.0, 2.0]), (220, [single(0.3), -1.0]), (None, rows[0][1]), (230, [0.0] * 6), (231, [30000.0] * 6), (5, rows[9][1])]
    frame = spark.createDataFrame([(i, v, 0, 1, "p") for i, v in rows], SCHEMA).repartition(4)
    got = va_search.top_k(spark, frame, F.col("vec_id") % 10 == 0, shared_folder(spark, "v"), k=10)
    assert by(got.collect(), "query_id", "rank", "vec_id", "score") == sorted(brute(rows, 10, 10))


def test_empty(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert va_search.top_k(spark, frame, F.col("vec_id") % 10 == 0, shared_folder(spark, "v")).collect() == []
