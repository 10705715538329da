"""Exact top-k search by inner product with vector-approximation files.

Every vector is stored twice: as cells (a byte per dimension, the number of an interval of that dimension) and exactly.
A query first scans the cells of a block: the ends of the intervals bound each score from below and above. What cannot
reach the kth best lower bound is left out; of the rest exact vectors are read from the file in the order of their upper
bounds, until the kth exact score is above the next bound. So a result is exact, with ties to the smaller id.

Vectors become integers, floor(scale * x). Work is dealt out by block of vectors and block of queries, read from files in
the shared folder; nothing is broadcast, and a block's answer is at most k rows a query.

Null vectors, and those with null or non-finite components, take no part. Vectors are only compared with those as long as themselves (empty ones score 0
with each other). Null ids take no part. Repeated ids: a row with a query's id is the query's own; a repeated query is answered for each row. Fewer than k candidates: all
of them. Scores beyond 64 bits are not defined.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradewind.llm.shared import file_system, new_file, stored

BLOCKS = "path string, dims int, n long"
CELLS = 64
BLOCK_ROWS = 4096
QUERY_ROWS = 256
PAGE_ROWS = 64
CANDIDATES_AT_ONCE = 16


def integers(vectors: pa.Array, scale: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Rows that take part, by their number of dimensions: positions and integer vectors."""
    kind = vectors.type.value_type if pa.types.is_list(vectors.type) else pa.float64()
    values = vectors.flatten().cast(pa.float64()) if kind else vectors.flatten()
    sizes = np.where(vectors.is_null().to_numpy(zero_copy_only=False), -1, vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    flat = values.fill_null(np.nan).to_numpy(zero_copy_only=False)
    starts = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
    out = {}
    for d in np.unique(sizes[sizes >= 0]).tolist():
        at = np.flatnonzero(sizes == d)
        block = flat[starts[at][:, None] + np.arange(d)]
        fine = np.isfinite(block).all(axis=1)
        out[d] = (at[fine], np.floor(block[fine] * scale).astype(np.int64))
    return out


# ---- files ------------------------------------------------------------------------------------------------


def edges(lowest: np.ndarray, highest: np.ndarray, cells: int) -> np.ndarray:
    """cells + 1 integer ends of each dimension's intervals; the last is exclusive."""
    span = highest - lowest + 1
    return lowest + -(-span * np.arange(cells + 1)[:, None] // cells)


def write_block(folder: str, name: str, ids: np.ndarray, vectors: np.ndarray, cells: int) -> tuple[str, int, int]:
    path = new_file(folder, name) + ".va"
    fs, place = file_system(path)
    fs.create_dir(place.rpartition("/")[0], recursive=True)
    ends = edges(vectors.min(axis=0, initial=np.iinfo(np.int64).max), vectors.max(axis=0, initial=np.iinfo(np.int64).min), cells)
    codes = np.empty(vectors.shape, np.uint8)
    for d in range(vectors.shape[1]):
        codes[:, d] = np.searchsorted(ends[:, d], vectors[:, d], "right") - 1
        # Intervals without integers repeat an end; the last of them holds the value.
    parts = [ids.astype("<i8").tobytes(), ends.astype("<i8").tobytes(), codes.tobytes(), vectors.astype("<i8").tobytes()]
    head = json.dumps({"n": len(ids), "dims": vectors.shape[1], "cells": cells}).encode().ljust(256)
    with fs.open_output_stream(place, compression=None) as out:
        for p in (head, *parts):
            out.write(p)
    return path, vectors.shape[1], len(ids)


class Block:
    """A block's ids and cells in memory; exact vectors are read when asked for, a page of rows at a time."""

    def __init__(self, path: str):
        fs, place = file_system(path)
        self.file = fs.open_input_file(place)
        head = json.loads(self.file.read_at(256, 0))
        n, self.dims, cells = head["n"], head["dims"], head["cells"]
        at, self.n = 256, n
        self.ids = np.frombuffer(self.file.read_at(8 * n, at), "<i8")
        at += 8 * n
        ends = np.frombuffer(self.file.read_at(8 * self.dims * (cells + 1), at), "<i8").reshape(cells + 1, self.dims)
        at += 8 * self.dims * (cells + 1)
        codes = np.frombuffer(self.file.read_at(n * self.dims, at), np.uint8).reshape(n, self.dims)
        self.exact_at = at + n * self.dims
        self.pages: dict[int, np.ndarray] = {}
        columns = np.arange(self.dims)
        self.low = ends[codes, columns].astype(np.float64)
        self.high = (ends[codes + 1, columns] - 1).astype(np.float64)

    def exact(self, rows: np.ndarray) -> np.ndarray:
        for p in np.unique(rows // PAGE_ROWS).tolist():
            if p not in self.pages:
                m = min(PAGE_ROWS, self.n - p * PAGE_ROWS)
                raw = self.file.read_at(8 * m * self.dims, self.exact_at + 8 * p * PAGE_ROWS * self.dims)
                self.pages[p] = np.frombuffer(raw, "<i8").reshape(m, self.dims)
        return np.stack([self.pages[r // PAGE_ROWS][r % PAGE_ROWS] for r in rows.tolist()])

    def all(self) -> np.ndarray:
        return self.exact(np.arange(self.n)) if self.n else np.empty((0, self.dims), np.int64)

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of each query's score with each vector. Exact below 2**53; widened by the rounding beyond."""
        plus, minus = np.maximum(queries, 0).astype(np.float64), np.minimum(queries, 0).astype(np.float64)
        lower, upper = plus @ self.low.T + minus @ self.high.T, plus @ self.high.T + minus @ self.low.T
        most = np.abs(queries).max(initial=0) * max(np.abs(self.low).max(initial=0), np.abs(self.high).max(initial=0)) * max(1, self.dims)
        slack = most * 2.0**-48 if most >= 2**52 else 0.0
        return lower - slack, upper + slack

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(number of the query, ids, scores) of its k best in this block, best first."""
        lower, upper = self.bounds(queries)
        own = query_ids[:, None] == self.ids[None, :]
        lower[own] = upper[own] = -np.inf
        kth = np.partition(lower, self.n - k, axis=1)[:, self.n - k] if self.n > k else np.full(len(queries), -np.inf)
        for q in range(len(queries)):
            rows = np.flatnonzero((upper[q] >= kth[q]) & ~own[q])
            rows = rows[np.lexsort((self.ids[rows], -upper[q, rows]))]
            ids, scores = np.empty(0, np.int64), np.empty(0, np.int64)
            for at in range(0, len(rows), CANDIDATES_AT_ONCE):
                if len(ids) == k and upper[q, rows[at]] < scores[-1]:
                    break  # neither this nor a later vector can come before the kth
                some = rows[at : at + CANDIDATES_AT_ONCE]
                scores = np.concatenate([scores, self.exact(some) @ queries[q]])
                ids = np.concatenate([ids, self.ids[some]])
                best = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[best], scores[best]
            yield q, ids, scores


# ---- Spark ------------------------------------------------------------------------------------------------


def write_blocks(vectors: DataFrame, folder: str, scale: int, rows: int, cells: int, name: str) -> DataFrame:
    """Blocks of (vec_id, embedding), at most ``rows`` each; the manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        made = []

        def flush(d: int, least: int) -> None:
            ids = np.concatenate([i for i, _ in held[d]])
            exact = np.concatenate([v for _, v in held[d]])
            while len(ids) >= least:
                made.append(write_block(f"{folder}/{name}", "block", ids[:rows], exact[:rows], cells))
                ids, exact = ids[rows:], exact[rows:]
            held[d] = [(ids, exact)]

        for batch in batches:
            all_ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
            for d, (at, exact) in integers(batch.column("embedding"), scale).items():
                held.setdefault(d, []).append((all_ids[at].astype(np.int64), exact))
                if sum(len(i) for i, _ in held[d]) >= rows:
                    flush(d, rows)
        for d in held:
            flush(d, 1)
        yield pa.RecordBatch.from_pydict({"path": pa.array([p for p, _, _ in made], pa.string()), "dims": pa.array([d for _, d, _ in made], pa.int32()), "n": pa.array([n for _, _, n in made], pa.int64())})

    return stored(vectors.mapInArrow(run, BLOCKS), f"{folder}/{name}-manifest")


def top_k(spark: SparkSession, vectors: DataFrame, is_query: F.Column, folder: str, k: int = 10, scale: int = 1024, cells: int = CELLS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all rows of (vec_id, embedding) for each row that ``is_query`` holds for."""
    chosen = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).where("vec_id IS NOT NULL")
    asked = chosen.where(is_query)
    n, m = (df.select("vec_id").count() for df in (chosen, asked))
    parts = max(1, chosen.rdd.getNumPartitions())
    blocks = write_blocks(chosen.coalesce(min(parts, -(-n // BLOCK_ROWS) or 1)), folder, scale, BLOCK_ROWS, cells, "vectors")
    questions = write_blocks(asked.repartition(-(-m // QUERY_ROWS) or 1, "vec_id"), folder, scale, QUERY_ROWS, cells, "queries")
    # One row per file is numbered, and a row per pair of files made: the stated query set against all rows, in blocks.
    numbered = questions.select(F.col("path").alias("asked"), "dims", (F.row_number().over(Window.orderBy("path")) - 1).alias("number"))
    numbered = stored(numbered, f"{folder}/questions")
    pairs = blocks.select("path", "dims", F.explode(F.sequence(F.lit(0), F.lit(max(0, numbered.count() - 1)))).alias("number")).join(numbered, ["number", "dims"])
    pairs = stored(pairs.select("path", "asked"), f"{folder}/pairs")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, block = None, None
        for batch in batches:
            for path, asked_path in zip(batch["path"], batch["asked"]):
                if path != at:
                    at, block = path, Block(path)
                question = Block(asked_path)
                found = [(question.ids[q], q, ids, scores) for q, ids, scores in block.search(question.ids, question.all(), k) if len(ids)]
                sizes = [len(i) for *_, i, _ in found]
                yield pd.DataFrame({
                    "asked": np.repeat(asked_path, sum(sizes)),
                    "row": np.repeat(np.array([q for _, q, _, _ in found], np.int64), sizes),
                    "query_id": np.repeat(np.array([i for i, *_ in found], np.int64), sizes),
                    "vec_id": np.concatenate([i for *_, i, _ in found]) if found else np.empty(0, np.int64),
                    "score": np.concatenate([s for *_, s in found]) if found else np.empty(0, np.int64),
                })

    tasks = min(max(1, pairs.count()), 10_000)
    local = pairs.repartitionByRange(tasks, "path", "asked").sortWithinPartitions("path").mapInPandas(run, "asked string, row long, query_id long, vec_id long, score long")
    best = Window.partitionBy("asked", "row", "query_id").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
