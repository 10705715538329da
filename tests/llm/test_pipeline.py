"""Every stage against what its operator decides, found anew from the stage's own input."""

import zlib

import corpus_pipeline
import numpy as np
from tests.llm import cases
from tests.llm.test_jaccard_tree import brute
from tests.llm.test_secrets import base
from tests.llm.test_token_files import ids_of
from tradewind.llm import decontaminate, knn_quality, packing, shared

FOLDER = "/root/testdata/sf0.001"


def rows_of(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, folder = docs.columns, shared.shared_folder(spark, "test-pipeline")
    inputs = [docs]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        inputs.append(shared.stored(stage(spark, inputs[-1], FOLDER), f"{folder}/{n}"))
        assert n == len(corpus_pipeline.STAGES) - 1 or inputs[-1].columns == columns
    given, good, single, clean, masked, packed = inputs
    # quality: the scores decide
    model = knn_quality.fit(spark, given, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    scores = knn_quality.classified(knn_quality.score(spark, given, model)).collect()
    assert set(rows_of(good)) == {r["doc_id"] for r in scores if r["predicted"]}
    # near duplicates: one of each group, found from all pairs
    texts = [(i, r["text"]) for i, r in sorted(rows_of(good).items())]
    assert set(rows_of(single)) == {i for i, _, c in brute(texts) if i == c}
    # benchmark passages: exact ones by substring search
    even = lambda t: "".join(map(chr, decontaminate.symbols(t)))
    items = [even(r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    holds = {i for i, r in rows_of(single).items() if any(x in even(r["text"]) for x in items)}
    assert holds and not holds & set(rows_of(clean))
    # secrets: nothing of the base rules is left, clean texts are as they were
    before, after = rows_of(clean), rows_of(masked)
    assert set(before) == set(after)
    assert all(not base(r["text"]) for r in after.values())
    assert all(after[i]["text"] == r["text"] for i, r in before.items() if "[SECRET]" not in after[i]["text"])
    assert all(r["n_chars"] == len(r["text"]) for r in after.values() if "[SECRET]" in r["text"])
    # packing: every token once
    pieces = {}
    for r in packed.collect():
        pieces.setdefault(r["doc_id"], []).append(r)
    assert set(pieces) == set(after)
    for i, r in after.items():
        ids = np.array([*ids_of(r["text"]), 2], "<u4")
        mine = sorted(pieces[i], key=lambda p: p["piece"])
        assert [p["start"] for p in mine] == [0, *np.cumsum([p["length"] for p in mine])[:-1].tolist()]
        assert [p["ids_crc32"] for p in mine] == [zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()) for p in mine]


def test_run_gives_the_last_stage(spark):
    got = corpus_pipeline.run(spark, FOLDER)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert got.count() > 0


def test_stages_take_awkward_rows(spark):
    """Nulls, empty and very long texts, repeated rows, columns with names that the stages use inside; every stage on its predecessor's rows."""
    rows = cases.texts() + [(90, "x = 'y'; password: " + "aB3" * 5 + " end. " * 30)]
    docs, folder = cases.documents(spark, rows, extra=True), shared.shared_folder(spark, "test-awkward")
    columns, extras, given = docs.columns, cases.CLASHING, docs
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = shared.stored(stage(spark, docs, FOLDER), f"{folder}/{n}")
        if n < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            kept = docs.select("doc_id", "text", *extras).collect()
            assert all(r[c] == "1" for r in kept for c in extras)
            assert {r["doc_id"] for r in kept} <= {i for i, _ in rows}
    by_id = {}
    for r in docs.collect():
        by_id.setdefault(r["doc_id"], []).append(r)
    assert {70, 71, 72} & set(by_id) in ({70, 71, 72}, set())  # without words: all alike
    assert all(sum(p["length"] for p in by_id[i]) == 1 for i in (70, 71) if i in by_id)  # an end id alone
    empty = given.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, FOLDER).count() == 0


def test_packing_is_held_to_the_pipelines_bounds(spark, monkeypatch):
    asked, read = {}, "spark.sql.parquet.columnarReaderBatchSize"
    pack = packing.pack
    monkeypatch.setattr(packing, "pack", lambda *a, **b: asked.update(b) or pack(*a, **b))
    before = spark.conf.get(read)
    try:
        spark.conf.set(read, "4096")
        corpus_pipeline.best_fit_packing(spark, cases.documents(spark, [(1, "a b"), (2, None)]), FOLDER)
        assert int(spark.conf.get(read)) == shared.READ_ROWS
    finally:
        spark.conf.set(read, before)
    assert asked["words"] <= 200_000 and asked["chars"] <= 1_000_000
