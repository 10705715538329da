"""Approximate nearest neighbours by cosine, with multi-index hashing of learned binary codes.

A bounded sample of rows fits the codes: directions are centred, turned into their principal axes, and rotated until their signs
lose least (iterative quantisation); where a code has more bits than the vectors have dimensions, several rotations from different starts
stand side by side. Every row is then coded and written into a block's file: exact vectors, codes, and for each 16-bit substring
of the code an index from its values to rows. A search for all codes within a Hamming radius probes each substring's index
within its share of the radius - two codes within the radius must agree that well in one substring - by enumerating the flips or,
where fewer, the values present; checks the whole code; and reranks what is left by the cosine of the vectors as given.

The radius is measured, not set: for a bounded sample of the queries the nearest are found among all rows, and the radius takes in the
stated share (``recall``) of them. A query with fewer than k in the radius is asked again with the widest one, so all get k.

Queries are a stated set, dealt out in small files against groups of blocks; a task keeps the k best of a query, so copies, however
many, give a few rows. Equal vectors of a block are one entry with their k + 1 smallest ids. Driver and tasks get the rotation (dimensions x bits) and
file names of one group; the driver collects only the two samples.

Vectors null, empty, zero or holding null or non-finite components take no part, nor do null ids. Vectors are compared with those as long as
themselves, a code for each length. A row with a query's id is the query's own; a repeated query is answered for each row. Ties go to the
smaller id. Fewer than k candidates: all. Vectors are scaled by powers of two, so very large and small ones neither overflow nor
vanish. Other columns are ignored.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradewind.llm.shared import file_system, give_back, new_file, stored

BITS = 256
SUB = 16
FIT_ROWS, FIT_COMPONENTS = 8_192, 4_000_000  # bounds of the sample that the codes are fitted on
MEASURED_QUERIES = 256
BLOCK_ROWS, BLOCK_COMPONENTS = 16_384, 4_000_000
QUERY_ROWS = 128
GROUP_BLOCKS = 8
RERANKED_AT_ONCE = 4_096

Model = tuple[np.ndarray, np.ndarray]  # centre, rotation

MANIFEST = "path string, dims int, n long"
FOUND = "asked string, row int, query_id long, vec_id long, score double, distance int"


# ---- codes --------------------------------------------------------------------------------------------------


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Every row times a power of two, its largest component between a half and one."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, initial=0))[1][:, None])


def lengths(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors * vectors).sum(axis=1))


def fit(sample: np.ndarray, bits: int = BITS, rounds: int = 40, seed: int = 7) -> Model:
    """Centre and rotation (dimensions x bits) of the codes; any sample gives codes, a small one only poorer ones."""
    d = sample.shape[1]
    unit = sample / lengths(sample)[:, None] if len(sample) else sample
    centre = unit.mean(axis=0) if len(unit) else np.zeros(d)
    _, axes = np.linalg.eigh((unit - centre).T @ (unit - centre))
    axes = axes[:, ::-1][:, : min(d, bits)]
    flat, rng, found = (unit - centre) @ axes, np.random.default_rng(seed), []
    for _ in range(-(-bits // axes.shape[1])):
        turn = np.linalg.qr(rng.normal(size=(axes.shape[1],) * 2))[0]
        for _ in range(rounds):
            left, _, right = np.linalg.svd(np.where(flat @ turn > 0, 1.0, -1.0).T @ flat)
            turn = (left @ right).T
        found.append(axes @ turn)
    return centre, np.hstack(found)[:, :bits]


def coded(vectors: np.ndarray, model: Model) -> np.ndarray:
    """Codes of scaled vectors, as 16-bit substrings."""
    centre, turn = model
    return np.packbits((vectors / lengths(vectors)[:, None] - centre) @ turn > 0, axis=1).view(np.uint16)


def shares(radius: int, parts: int) -> list[int]:
    """Radius of each substring. Were all beyond theirs, the codes would differ in more than ``radius`` bits."""
    whole, rest = divmod(radius, parts)
    return [whole] * (rest + 1) + [whole - 1] * (parts - rest - 1)


@lru_cache(maxsize=SUB + 1)
def flips(radius: int) -> np.ndarray:
    every = np.arange(1 << SUB, dtype=np.uint16)
    return every[np.bitwise_count(every) <= radius]


# ---- files --------------------------------------------------------------------------------------------------


def save(path: str, **arrays: np.ndarray) -> None:
    raw = io.BytesIO()
    np.savez(raw, **arrays)
    fs, place = file_system(path)
    fs.create_dir(place.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(place, compression=None) as out:
        out.write(raw.getbuffer())


def load(path: str) -> dict[str, np.ndarray]:
    fs, place = file_system(path)
    with fs.open_input_file(place) as file:
        return dict(np.load(io.BytesIO(file.read())))


def block(ids: np.ndarray, vectors: np.ndarray, model: Model, k: int) -> dict[str, np.ndarray]:
    """The index of a block: distinct vectors, their smallest ids, codes, and rows by value of each substring."""
    _, first, which = np.unique(vectors.view(f"V{8 * vectors.shape[1]}").ravel(), return_index=True, return_inverse=True)
    order = np.lexsort((ids, which))
    ids, which = ids[order], which[order]
    # k + 1 different ids of a vector, each k times at most: whatever a query's own id is, the k smallest others are among them.
    new_vector = np.diff(which, prepend=-1) != 0
    new_id = new_vector | (np.diff(ids, prepend=0) != 0)
    at = np.arange(len(ids))
    repeat = at - np.maximum.accumulate(np.where(new_id, at, 0))
    nth = np.cumsum(new_id)
    nth -= np.maximum.accumulate(np.where(new_vector, nth, 0))
    few = (repeat < k) & (nth <= k)
    vectors = vectors[first]
    codes = coded(vectors, model)
    by_value = np.argsort(codes, axis=0, kind="stable").T.astype(np.int32)
    values, sizes, parts = [], [], []
    for j, rows in enumerate(by_value):
        found, count = np.unique(codes[rows, j], return_counts=True)
        values.append(found), sizes.append(count), parts.append(len(found))
    return {"ids": ids[few], "owner": which[few], "vectors": vectors, "codes": codes, "rows": by_value, "values": np.concatenate(values), "sizes": np.concatenate(sizes), "parts": np.array(parts)}


class Index:
    def __init__(self, path: str):
        self.__dict__.update(load(path))
        self.length = lengths(self.vectors)
        self.wide = np.ascontiguousarray(self.codes).view(np.uint64)
        at = np.cumsum(self.parts)[:-1]
        self.values, self.sizes = np.split(self.values, at), np.split(self.sizes, at)
        self.ends = [np.cumsum(s) for s in self.sizes]
        self.bounds = np.searchsorted(self.owner, np.arange(len(self.vectors) + 1))

    def probed(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows that some substring's index gives, ascending."""
        n = len(self.codes)
        if radius >= 16 * self.codes.shape[1]:
            return np.arange(n)
        seen = np.zeros(n, bool)
        for j, share in enumerate(shares(radius, self.codes.shape[1])):
            if share < 0:
                continue
            values = self.values[j]
            if len(ball := flips(share)) < len(values):
                asked = ball ^ code[j]
                at = np.minimum(np.searchsorted(values, asked), len(values) - 1)
                at = at[values[at] == asked]
            else:
                at = np.flatnonzero(np.bitwise_count(values ^ code[j]) <= share)
            size = self.sizes[j][at]
            seen[self.rows[j][np.repeat(self.ends[j][at] - np.cumsum(size), size) + np.arange(size.sum())]] = True
        return np.flatnonzero(seen)

    def within(self, code: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Every row whose code is within the radius, and its distance."""
        rows = self.probed(code, radius)
        distance = np.bitwise_count(self.wide[rows] ^ np.ascontiguousarray(code).view(np.uint64)).sum(axis=1)
        near = distance <= radius
        return rows[near], distance[near].astype(np.int32)

    def nearest(self, own: int, vector: np.ndarray, code: np.ndarray, radius: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, cosines and code distances of the k nearest in the radius but the query's own."""
        rows, distance = self.within(code, radius)
        others = (self.ids[self.bounds[rows]] != own) | (self.ids[self.bounds[rows + 1] - 1] != own)
        rows, distance = rows[others], distance[others]
        products = [(self.vectors[some] * vector).sum(axis=1) for some in np.split(rows, range(RERANKED_AT_ONCE, len(rows), RERANKED_AT_ONCE))]
        scores = np.concatenate(products) / (self.length[rows] * np.sqrt((vector * vector).sum()))
        if len(rows) > k:
            best = scores >= np.partition(scores, len(rows) - k)[len(rows) - k]
            rows, distance, scores = rows[best], distance[best], scores[best]
        size = self.bounds[rows + 1] - self.bounds[rows]
        ids = self.ids[np.repeat(self.bounds[rows + 1] - np.cumsum(size), size) + np.arange(size.sum())]
        return best_of(*(x[ids != own] for x in (ids, np.repeat(scores, size), np.repeat(distance, size))), k)


def best_of(ids: np.ndarray, scores: np.ndarray, distance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order], distance[order]


# ---- Spark --------------------------------------------------------------------------------------------------


def able(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part."""
    v = F.col("embedding")
    fine = F.col("vec_id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long"), v.cast("array<double>")).where(fine)


def matrices(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimensions, ids, scaled vectors) by number of dimensions."""
    ids, lists = batch.column("vec_id").to_numpy(zero_copy_only=False), batch.column("embedding")
    size = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat, starts = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(size) - size
    for d in np.unique(size).tolist():
        at = np.flatnonzero(size == d)
        yield d, ids[at], scaled(flat[starts[at][:, None] + np.arange(d)])


def write_files(vectors: DataFrame, folder: str, models: dict[int, Model], rows: int, k: int | None) -> DataFrame:
    """Files of at most ``rows`` vectors; indexes if ``k`` is given, else questions. The manifest."""

    def write(d: int, held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[str, int, int]:
        ids, exact = (np.concatenate(x) for x in zip(*held, strict=True))
        path = new_file(folder, "part")
        save(path, **(block(ids, exact, models[d], k) if k else {"ids": ids, "vectors": exact, "codes": coded(exact, models[d])}))
        return path, d, len(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        made = []
        for batch in batches:
            for d, ids, exact in matrices(batch):
                most, at = max(1, min(rows, BLOCK_COMPONENTS // d)), 0
                while at < len(ids):
                    mine = held.setdefault(d, [])
                    more = min(len(ids), at + most - sum(len(i) for i, _ in mine))
                    mine.append((ids[at:more], exact[at:more]))
                    at = more
                    if sum(len(i) for i, _ in mine) == most:
                        made.append(write(d, held.pop(d)))
        made += [write(d, parts) for d, parts in held.items()]
        held.clear()
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int64()))], ["path", "dims", "n"])

    return stored(vectors.mapInArrow(run, MANIFEST), f"{folder}-manifest")


def grouped(blocks: DataFrame, folder: str) -> DataFrame:
    """(dims, number, paths): at most GROUP_BLOCKS files each. A row a file is numbered in one task."""
    number = F.floor((F.row_number().over(Window.partitionBy("dims").orderBy("path")) - 1) / GROUP_BLOCKS)
    return stored(blocks.withColumn("number", number).groupBy("dims", "number").agg(F.collect_list("path").alias("paths")), folder)


def search(questions: DataFrame, groups: DataFrame, radius: dict[int, int], k: int) -> DataFrame:
    """FOUND rows: the k best of each group of blocks for each question of (asked, dims, rows: those of the file, or null for all). A question without any has a row without vec_id."""
    pairs = questions.join(groups, "dims")
    tasks = min(max(1, pairs.count()), 10_000)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for pair in batch.itertuples():
                question = load(pair.asked)
                asked = list(range(len(question["ids"]))) if pair.rows is None else list(pair.rows)
                best = {q: (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int32)) for q in asked}
                for path in pair.paths:
                    index = Index(path)
                    for q in asked:
                        more = index.nearest(question["ids"][q], question["vectors"][q], question["codes"][q], radius[pair.dims], k)
                        best[q] = best_of(*(np.concatenate(x) for x in zip(best[q], more, strict=True)), k)
                rows = [(pair.asked, q, int(question["ids"][q]), *x) for q in asked for x in zip(*(y.tolist() for y in best[q]), strict=True)]
                rows += [(pair.asked, q, int(question["ids"][q]), None, None, None) for q in asked if not len(best[q][0])]
                yield pd.DataFrame(rows, columns=["asked", "row", "query_id", "vec_id", "score", "distance"]).astype({"vec_id": "Int64", "distance": "Int32"})
        give_back()

    return pairs.select("dims", "asked", "rows", "number", "paths").repartitionByRange(tasks, "dims", "number", "asked").mapInPandas(run, FOUND)


def best_rows(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("asked", "row").orderBy(F.col("vec_id").isNull(), F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(spark: SparkSession, vectors: DataFrame, is_query: Column, folder: str, k: int = 5, bits: int = BITS, recall: float = 0.97) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found among all rows for each row of (vec_id, embedding) that ``is_query`` holds for."""
    if bits % 64:
        raise ValueError("bits come in multiples of 64")
    rows = able(vectors)
    asked = rows.where(is_query)
    dims = F.size("embedding")
    counts = {r["dims"]: r["n"] for r in rows.groupBy(dims.alias("dims")).agg(F.count("*").alias("n")).collect()}  # a row per length
    by_hash = [F.xxhash64("vec_id"), F.col("vec_id"), F.xxhash64("embedding")]
    models: dict[int, Model] = {}
    for d in counts:
        sample = rows.where(dims == d).orderBy(*by_hash).limit(max(1, min(FIT_ROWS, FIT_COMPONENTS // d)))
        models[d] = fit(scaled(np.array([r["embedding"] for r in sample.select("embedding").collect()], float)), bits)
    parts = max(1, rows.rdd.getNumPartitions())
    blocks = write_files(rows.coalesce(min(parts, -(-sum(counts.values()) // BLOCK_ROWS) or 1)), f"{folder}/blocks", models, BLOCK_ROWS, k)
    groups = grouped(blocks, f"{folder}/groups")

    def questions(of: DataFrame, name: str) -> DataFrame:
        files = write_files(of.repartition(-(-of.count() // QUERY_ROWS) or 1, "vec_id"), f"{folder}/{name}", models, QUERY_ROWS, None)
        return files.select(F.col("path").alias("asked"), "dims", F.lit(None).cast("array<int>").alias("rows"))

    # The radius of each length: that of the stated share of true neighbours of some of its queries.
    radius = dict.fromkeys(counts, bits)
    for d in counts:
        measured = questions(asked.where(dims == d).orderBy(*by_hash).limit(MEASURED_QUERIES), f"measured-{d}")
        near = best_rows(search(measured, groups, dict.fromkeys(counts, bits), k), k).where("vec_id IS NOT NULL")
        distances = sorted(r["distance"] for r in near.select("distance").collect())  # k of each measured query
        if distances:
            radius[d] = distances[min(len(distances) - 1, int(np.ceil(recall * len(distances))) - 1)]
    every = questions(asked, "questions")
    first = stored(best_rows(search(every, groups, radius, k), k), f"{folder}/first")
    # Queries with too few in the radius are asked again with the widest one.
    short = first.groupBy("asked", "row").agg(F.count("vec_id").alias("n")).where(F.col("n") < k).select("asked", "row")
    short = stored(short, f"{folder}/short")
    again = short.groupBy("asked").agg(F.collect_list("row").alias("rows")).join(every.drop("rows"), "asked")
    second = best_rows(search(again.select("asked", "dims", "rows"), groups, dict.fromkeys(counts, bits), k), k)
    both = first.join(short, ["asked", "row"], "left_anti").unionByName(second)
    return both.where("vec_id IS NOT NULL").select("query_id", "rank", "vec_id", "score")
