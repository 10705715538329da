"""Quality by the votes of the nearest labelled documents in a latent space.

A text's terms are its words and its sequences of one to three code points, both hashed, and beside them its
three-byte shapes (each byte as one of 16 classes: vowels, consonants, digits, marks and so on) and the share of words that repeat
the word before. Their weights (root of the relative frequency times the inverse document frequency) go through truncated singular
value decompositions, one of the words and sequences and one of the shapes, fitted on the labelled sample; what is left are twice
``dims`` latent numbers. How much the shapes count is what scores the sample best, each text by the others (``mixed``). The labelled vectors and the projection are broadcast; they have at most
``2 * per_class`` rows. Each block of documents is multiplied with all of them, exactly, and the ``neighbours`` largest
cosines vote with the power of their similarity. Classes are sampled alike and weighted back to their share among all labels.

The sample: of either class, the ``per_class`` labelled rows with the smallest hash of doc_id, held-out rows excluded. This
bounds the model whatever the size of the corpus; every document is scored over its whole text.

Null and empty texts have no terms: they score the share of label 1. So do all documents if no label can be used (0.5 if there is none).
Null doc_ids are scored and not held out. Labels that are null or not 0 or 1 are not used; a repeated label counts once, and so does
a document that is there several times (with its smallest text). Repeated rows are scored each. Only doc_id, text and quality are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.llm.shared import crc32_mod5, give_back

PER_CLASS = 2_000
DIMS = 48
NEIGHBOURS = 25
SHARPNESS = 8
THRESHOLD = 0.3
BLOCK_BYTES = 4_000_000
BLOCK_DOCS = 192

SHAPES = 16**3
REPEATS = SHAPES  # the number of the last of the shapes' terms
WORD_BITS, GRAM_BITS = 12, 13
WORDS = SHAPES + 1  # the number of the first word
GRAMS = WORDS + (1 << WORD_BITS)  # of the first sequence of characters
TERMS = GRAMS + (1 << GRAM_BITS)
MIXES = (0.1, 0.3, 0.5, 0.7, 0.9)  # shares of the shapes in the cosine
TRIED = 1_000  # texts of the sample by which one of them is chosen


def _classes() -> np.ndarray:
    table = np.full(256, 15, np.uint8)  # bytes of other than ASCII characters
    table[:128] = 14  # control characters and what is not named below
    for k, chars in enumerate(["aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "0123456789", " ", "\n", "|", "!", ".", ",", ";:?'\"()-", "#$%&*@^~", "<>=+/\\_`{}[]"]):
        table[list(chars.encode())] = k
    return table


CLASSES = _classes()


# ---- terms ------------------------------------------------------------------------------------------------


def blocks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes of its and the following texts, their ends), a bounded number of bytes or one text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        before = size[at - 1] if at else 0
        to = min(at + BLOCK_DOCS, max(at + 1, int(np.searchsorted(size, before + BLOCK_BYTES, "right"))))
        joined = "".join(texts.slice(at, to - at).to_pylist()).encode()
        yield at, np.frombuffer(joined, np.uint8), size[at:to] - before
        at = to
        give_back()


def weights(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Root of the relative frequency of each term, a row per text."""
    n = len(ends)
    out = np.zeros((n, TERMS), np.float32)
    starts = np.concatenate([[0], ends[:-1]])
    if len(raw) >= 3:
        shape = CLASSES[raw].astype(np.int32)
        shape = shape[:-2] << 8 | shape[1:-1] << 4 | shape[2:]
        doc = np.repeat(np.arange(n, dtype=np.int32), ends - starts)[:-2]
        inside = np.ones(len(shape), bool)
        for back in (1, 2):  # not across the end of a text
            cut = ends - back
            inside[cut[(cut >= 0) & (cut < len(shape))]] = False
        out[:, :SHAPES] = np.bincount(doc[inside] * SHAPES + shape[inside], minlength=n * SHAPES).reshape(n, SHAPES)
        out[:, :SHAPES] /= np.maximum(1, out.sum(axis=1, keepdims=True))
    words, doc = word_hashes(raw, starts, ends)
    same = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
    count = np.bincount(doc, minlength=n)
    out[:, REPEATS] = np.bincount(doc[1:][same], minlength=n) / np.maximum(1, count)
    buckets = (words * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    out[:, WORDS:GRAMS] = np.bincount((doc << WORD_BITS) + buckets, minlength=n << WORD_BITS).reshape(n, -1)
    out[:, WORDS:GRAMS] /= np.maximum(1, count)[:, None]
    for buckets, doc in sequences(raw, ends):
        out[:, GRAMS:] += np.bincount((doc << GRAM_BITS) + buckets, minlength=n << GRAM_BITS).reshape(n, -1)
    out[:, GRAMS:] /= np.maximum(1, out[:, GRAMS:].sum(axis=1, keepdims=True))
    return np.sqrt(out)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word, in order, and its text."""
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    first = ~blank
    first[1:] &= blank[:-1]
    first[starts[starts < len(raw)]] = ~blank[starts[starts < len(raw)]]
    at = np.flatnonzero(first)
    if not len(at):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    place = np.arange(len(raw)) - np.repeat(np.concatenate([[0], at]), np.diff(np.concatenate([[0], at, [len(raw)]])))
    mixed = (place.astype(np.uint64) << np.uint64(8) | raw) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    mixed[blank] = 0
    return np.add.reduceat(mixed, at), np.searchsorted(ends, at, "right")


def sequences(raw: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For one, two and three characters: hashes of the sequences within a text, and their texts."""
    code = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
    ends = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[ends]
    doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    h = code * np.uint32(0x9E3779B1)
    for back in range(min(3, len(code))):
        if back:
            h = (h[:-1] ^ h[:-1] >> np.uint32(15)) * np.uint32(0x85EBCA6B) + code[back:] * np.uint32(0xC2B2AE35)
        inside = doc[back:] == doc[: len(doc) - back]
        yield ((h ^ h >> np.uint32(16)) * np.uint32(0x7FEB352D) >> np.uint32(32 - GRAM_BITS))[inside].astype(np.int64), doc[back:][inside]


# ---- model ------------------------------------------------------------------------------------------------


@dataclass
class Model:
    idf: np.ndarray  # by term
    projections: tuple[np.ndarray, np.ndarray]  # of shapes, of words and sequences: terms x dims
    vectors: np.ndarray  # labelled x dims, at most of unit length
    votes: np.ndarray  # labelled x 2: weight, weight * label
    prior: float
    mix: float = 0.5  # share of the shapes in the cosine

    def latent(self, raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
        x = weights(raw, ends)
        x *= self.idf
        return joined(*apart(x, self.projections), self.mix)

    def score(self, raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not len(self.vectors):
            return np.full(len(ends), self.prior)
        cosine = self.latent(raw, ends) @ self.vectors.T
        return voted(cosine, self.votes, self.prior)


def voted(cosine: np.ndarray, votes: np.ndarray, prior: float) -> np.ndarray:
    k = min(NEIGHBOURS, cosine.shape[1])
    # Ties at the kth cosine are all counted, so the order of the sample decides nothing.
    kth = np.partition(cosine, cosine.shape[1] - k, axis=1)[:, cosine.shape[1] - k]
    near = np.where(cosine >= kth[:, None], np.maximum(cosine, 0) ** SHARPNESS, 0).astype(np.float64)
    total = near @ votes
    return np.where(total[:, 0] > 0, total[:, 1] / np.maximum(total[:, 0], 1e-300), prior).clip(0, 1)


def apart(x: np.ndarray, projections: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return unit(x[:, :WORDS] @ projections[0]), unit(x[:, WORDS:] @ projections[1])


def joined(shapes: np.ndarray, words: np.ndarray, mix: float) -> np.ndarray:
    return np.concatenate([shapes * np.float32(mix**0.5), words * np.float32((1 - mix) ** 0.5)], axis=1)


def mixed(shapes: np.ndarray, words: np.ndarray, votes: np.ndarray, prior: float) -> float:
    """The share of the shapes by which texts of the sample, each scored by the others, come nearest to their labels."""
    rows = np.arange(0, len(votes), -(-len(votes) // TRIED))
    truth, weight = votes[rows, 1] / np.maximum(votes[rows, 0], 1e-300), votes[rows, 0]
    errors = []
    for mix in MIXES:
        vectors = joined(shapes, words, mix)
        cosine = vectors[rows] @ vectors.T
        cosine[np.arange(len(rows)), rows] = -1
        errors.append(float((weight * (voted(cosine, votes, prior) - truth) ** 2).sum()))
    return MIXES[int(np.argmin(errors))]


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class Sample:
    """Weights of the labelled texts' terms, those above zero only: the terms of all texts one after the other, and where each text's end."""

    used: np.ndarray
    values: np.ndarray
    ends: np.ndarray

    def __len__(self) -> int:
        return len(self.ends)

    def parts(self, first: int, last: int) -> Iterator[tuple[slice, np.ndarray]]:
        """Columns first to last as plain rows, a few texts at a time."""
        for lo in range(0, len(self), BLOCK_DOCS):
            hi = min(lo + BLOCK_DOCS, len(self))
            begin = self.ends[lo - 1] if lo else 0
            row = np.repeat(np.arange(hi - lo), np.diff(self.ends[lo:hi], prepend=begin))
            term = self.used[begin : self.ends[hi - 1]].astype(np.int64)
            inside = (term >= first) & (term < last)
            out = np.zeros((hi - lo, last - first), np.float32)
            out[row[inside], term[inside] - first] = self.values[begin : self.ends[hi - 1]][inside]
            yield slice(lo, hi), out

    def times(self, first: int, last: int, matrix: np.ndarray) -> np.ndarray:
        return np.concatenate([x @ matrix for _, x in self.parts(first, last)])


def decompose(sample: Sample, first: int, last: int, dims: int, rounds: int = 4) -> np.ndarray:
    """Leading right singular vectors of the sample's columns first to last, by subspace iteration from a fixed start."""
    basis = np.random.default_rng(7).standard_normal((last - first, dims + 8)).astype(np.float32)
    for _ in range(rounds):
        grown = np.zeros_like(basis)
        for _, x in sample.parts(first, last):
            grown += x.T @ (x @ basis)
        basis, _ = np.linalg.qr(grown)
    _, _, right = np.linalg.svd(sample.times(first, last, basis), full_matrices=False)
    return (basis @ right.T)[:, :dims].astype(np.float32)


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, dims: int = DIMS) -> Model:
    usable = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).where(crc32_mod5() != 0).where("quality IN (0, 1)")
    share = usable.agg(F.count("*").alias("n"), F.sum("quality").alias("ones")).first()
    prior = (share["ones"] or 0) / share["n"] if share["n"] else 0.5
    picked = [usable.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for q in (0, 1)]
    picked = picked[0].unionAll(picked[1])  # at most 2 * per_class ids, so a broadcast has that bound
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(picked), "doc_id")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for _, raw, ends in blocks(batch.column("text")):
                for w in weights(raw, ends):
                    used = np.flatnonzero(w)
                    rows.append((used.astype("<u2").tobytes(), w[used].astype("<f4").tobytes()))
            used, values = zip(*rows) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array(used, pa.binary()), pa.array(values, pa.binary())], ["quality", "used", "weights"])

    # One text a picked id, however often the id stands among the documents.
    texts = texts.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    found = texts.select("text", "quality").mapInArrow(terms, "quality int, used binary, weights binary").collect()
    found.sort(key=lambda r: (r["quality"], r["used"], r["weights"]))
    quality = np.array([r["quality"] for r in found], np.float64)
    if not len(found):
        return Model(np.ones(TERMS, np.float32), (np.zeros((WORDS, 1), np.float32), np.zeros((TERMS - WORDS, 1), np.float32)), np.empty((0, 2), np.float32), np.empty((0, 2)), prior)
    used = np.frombuffer(b"".join(r["used"] for r in found), "<u2")
    values = np.frombuffer(b"".join(r["weights"] for r in found), "<f4")
    sample = Sample(used, values, np.cumsum([len(r["used"]) // 2 for r in found]))
    del found
    idf = (1 + np.log((1 + len(sample)) / (1 + np.bincount(used, minlength=TERMS)))).astype(np.float32)
    sample.values = values * idf[used]
    halves, dims = ((0, WORDS), (WORDS, TERMS)), min(dims, len(sample))
    projections = tuple(decompose(sample, *h, dims) for h in halves)
    weight = np.where(quality == 1, prior / max(quality.mean(), 1e-9), (1 - prior) / max(1 - quality.mean(), 1e-9))
    votes = np.stack([weight, weight * quality], axis=1)
    shapes, words = (unit(sample.times(*h, p)) for h, p in zip(halves, projections))
    mix = mixed(shapes, words, votes, prior)
    give_back()
    return Model(idf, projections, joined(shapes, words, mix), votes, prior, mix)


def score(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row; other columns of ``docs`` are not read."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.score(raw, ends) for _, raw, ends in blocks(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate([*scores, np.empty(0)]), pa.float64())], ["doc_id", "score"])
        give_back()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def classified(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    held_out = F.coalesce(crc32_mod5() == 0, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with their own columns: scored in one pass, nothing is joined."""
    shared = spark.sparkContext.broadcast(fit(spark, docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.score(raw, ends) for _, raw, ends in blocks(batch.column("text"))]
            yield batch.filter(pa.array(np.concatenate([*scores, np.empty(0)]) >= threshold))
        give_back()

    return docs.mapInArrow(run, docs.schema)
