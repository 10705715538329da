"""Log probabilities of texts by a bigram model in an Elias-Fano trie.

The first level holds the words, by a 64-bit hash, as ascending numbers; a word's rank among them is its id. Beside it stand
the running sum of counts (ascending, so in the same code) and the quantised probability. The second level is dealt out
by a hash of the pair, so that the followers of a frequent word are spread evenly: each of its files holds the contexts it
has (ascending), pointers to their followers (ascending) and the followers. These are stored as the id plus the last value of the
context before, which makes the whole level ascend and each context's part relative to its begin. A pair is looked up by
its context, the two pointers, and the first number not below begin + id. Probabilities are smoothed towards the unigram,

    p(w | c) = (count(c, w) + strength * p(w)) / (count(c) + strength),   p(w) = (count(w) + 0.5) / (N + 0.5 * (V + 1)),

and stored in 8 bits, evenly over the logarithm. A pair that was not seen has the context's share of p(w). The end of a
text is a word, and the context of the next first word. Counts cover the whole texts of all training documents.

Files lie in the shared folder and are memory-mapped by the tasks that read them; nothing of the model goes through the driver or
a broadcast but the files' names and sizes.

Null or empty text: the end alone. Null doc_ids: not held out, so part of the training. Repeated rows count each. No training
documents: every word is unknown. Words are told apart by their hash. The vocabulary is limited to 2**32 words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.llm import elias_fano
from tradewind.llm.elias_fano import File
from tradewind.llm.shared import bucket_count, by_bucket, crc32_mod5, per_bucket, stored
from tradewind.llm.words import blocks, hashes, mixed, word_codes

STRENGTH = 40.0
FLOOR = -16.0  # log10 of the least probability that has a code
HELD_ENTRIES = 3_000_000
SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"

END = hashes(pa.array([""]))[0]  # no word is empty


def quantised(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(log10 / FLOOR * 255), 0, 255).astype(np.uint8)


def value_of(codes: np.ndarray) -> np.ndarray:
    return codes * (FLOOR / 255)


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct keys and the sum of each."""
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
    return key[first], np.add.reduceat(count, first) if len(first) else count


class Counter:
    """Counts of 64-bit keys, combined whenever many are held."""

    def __init__(self):
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.held = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> bool:
        self.keys.append(keys)
        self.counts.append(counts)
        self.held += len(keys)
        if self.held > HELD_ENTRIES:
            self.keys, self.counts = ([x] for x in summed(self.keys, self.counts))
            self.held = len(self.keys[0])
        return self.held > HELD_ENTRIES // 2 and len(self.keys) == 1

    def blobs(self, bucket_of, buckets: int) -> pa.RecordBatch:
        key, count = summed(self.keys, self.counts) if self.keys else (np.empty(0, np.uint64), np.empty(0, np.int64))
        self.__init__()
        rows = [(b, key[at].tobytes() + count[at].astype("<u4").tobytes()) for b, at in by_bucket(bucket_of(key, buckets), buckets)]
        return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["bucket", "blob"])


def _read_blobs(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return summed([np.frombuffer(b, "<u8", len(b) // 12) for b in blobs], [np.frombuffer(b, "<u4", len(b) // 12, len(b) // 12 * 8).astype(np.int64) for b in blobs])


def range_of(key: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets in the order of the hashes."""
    return ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def range_start(bucket: int, buckets: int) -> int:
    return -(-(bucket << 32) // buckets) << 32


def hash_of(pair: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(pair + np.uint64(0x9E3779B97F4A7C15)) % np.uint64(buckets)).astype(np.int64)


# ---- the model as tasks see it ------------------------------------------------------------------------------


@dataclass
class Level:
    """One file of the first level."""

    words: elias_fano.EliasFano
    sums: elias_fano.EliasFano
    codes: np.ndarray


@dataclass
class Trie:
    buckets: int
    paths: dict[int, str]  # first level, by bucket
    starts: np.ndarray  # id of each bucket's first word
    tokens: int
    pair_buckets: int = 0
    pair_paths: dict[int, str] | None = None

    def __post_init__(self):
        self.open: dict[tuple[str, int], object] = {}

    def __getstate__(self):
        return self.__dict__ | {"open": {}}

    @property
    def words(self) -> int:
        return int(self.starts[-1])

    @property
    def unknown(self) -> float:
        return float(np.log10(0.5 / (self.tokens + 0.5 * (self.words + 1))))

    def level(self, bucket: int) -> Level | None:
        if ("w", bucket) not in self.open:
            f = File(self.paths[bucket]) if bucket in self.paths else None
            self.open["w", bucket] = f and Level(f.sequence("words"), f.sequence("sums"), f.arrays["codes"])
        return self.open["w", bucket]

    def look_up(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(id or -1, count, log10 of the stored probability) of word hashes."""
        ids, counts, p = np.full(len(word), -1), np.zeros(len(word), np.int64), np.full(len(word), self.unknown)
        for b, at in by_bucket(range_of(word, self.buckets), self.buckets):
            if level := self.level(b):
                place = level.words.find(word[at] - np.uint64(range_start(b, self.buckets)))
                at, place = at[place >= 0], place[place >= 0]
                ids[at] = self.starts[b] + place
                counts[at] = _difference(level.sums, place)
                p[at] = value_of(level.codes[place])
        return ids, counts, p

    def of_ids(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, log10 of the stored probability) of word ids."""
        counts, p = np.zeros(len(ids), np.int64), np.zeros(len(ids))
        for b, at in by_bucket(np.searchsorted(self.starts, ids, "right") - 1, self.buckets):
            level, place = self.level(b), ids[at] - self.starts[b]
            counts[at], p[at] = _difference(level.sums, place), value_of(level.codes[place])
        return counts, p

    def pairs(self, pair: np.ndarray) -> np.ndarray:
        """log10 p(w | c) of (c << 32 | w), nan for pairs that were not seen."""
        out = np.full(len(pair), np.nan)
        for b, at in by_bucket(hash_of(pair, self.pair_buckets), self.pair_buckets):
            if b not in self.pair_paths:
                continue
            if ("p", b) not in self.open:
                f = File(self.pair_paths[b])
                self.open["p", b] = (f.sequence("contexts"), f.sequence("pointers"), f.sequence("followers"), f.arrays["codes"])
            contexts, pointers, followers, codes = self.open["p", b]
            context, word = pair[at] >> np.uint64(32), pair[at] & np.uint64(0xFFFFFFFF)
            j = contexts.find(context)
            at, word, j = at[j >= 0], word[j >= 0], j[j >= 0]
            first, end = pointers.get(j).astype(np.int64), pointers.get(j + 1).astype(np.int64)
            begin = np.where(first > 0, followers.get(np.maximum(first - 1, 0)) + np.uint64(1), np.uint64(0))
            place = followers.successor(begin + word)
            inside = np.minimum(place, followers.n - 1)
            seen = (place < end) & (followers.get(inside) == begin + word)
            out[at[seen]] = value_of(codes[place[seen]])
        return out


def _difference(sums: elias_fano.EliasFano, i: np.ndarray) -> np.ndarray:
    return (sums.get(i + 1) - sums.get(i)).astype(np.int64)


# ---- training -----------------------------------------------------------------------------------------------


def _manifest(rows: DataFrame, folder: str) -> list:
    """One row a bucket, so their number is that of the partitions times a constant."""
    return sorted(stored(rows, folder).collect(), key=lambda r: r["bucket"])


def count_words(docs: DataFrame, folder: str) -> Trie:
    """The first level."""
    buckets = bucket_count(docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter()
        for batch in batches:
            for _, texts in blocks(batch.column("text")):
                words, codes, _ = word_codes(texts)
                if counter.add(np.append(hashes(words), END), np.append(np.bincount(codes, minlength=len(words)), len(texts))):
                    yield counter.blobs(range_of, buckets)
        yield counter.blobs(range_of, buckets)

    def merge(bucket: int, blobs: list[bytes]) -> Iterator[pd.DataFrame]:
        key, count = _read_blobs(blobs)
        plain = pack_pairs(key - np.uint64(range_start(bucket, buckets)), count)
        yield pd.DataFrame({"bucket": [bucket], "n": [len(key)], "tokens": [int(count.sum())], "blob": [plain]})

    counted = stored(per_bucket(docs.select("text").mapInArrow(count, "bucket int, blob binary"), merge, "bucket int, n long, tokens long, blob binary"), f"{folder}/counts")
    totals = counted.select("bucket", "n", "tokens").collect()
    n = np.zeros(buckets, np.int64)
    for r in totals:
        n[r["bucket"]] = r["n"]
    trie = Trie(buckets, {}, np.concatenate([[0], np.cumsum(n)]), sum(r["tokens"] for r in totals))
    if trie.words >= 2**32:
        raise ValueError("more than 2**32 words")
    scale = trie.tokens + 0.5 * (trie.words + 1)

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for bucket, blob in zip(part["bucket"].tolist(), part["blob"]):
                key, count = np.frombuffer(blob, "<u8", len(blob) // 16), np.frombuffer(blob, "<i8", len(blob) // 16, len(blob) // 2)
                span = range_start(bucket + 1, buckets) - range_start(bucket, buckets)
                sums = np.concatenate([[0], np.cumsum(count)])
                sequences = {"words": elias_fano.encode(key, span), "sums": elias_fano.encode(sums, int(sums[-1]) + 1)}
                path = elias_fano.write(f"{folder}/words", f"words-{bucket:06d}", sequences, codes=quantised(np.log10((count + 0.5) / scale)))
                yield pd.DataFrame({"bucket": [bucket], "path": [path]})

    files = _manifest(counted.select("bucket", "blob").mapInPandas(write, "bucket int, path string"), f"{folder}/words-files")
    trie.paths = {r["bucket"]: r["path"] for r in files}
    return trie


def pack_pairs(key: np.ndarray, count: np.ndarray) -> bytes:
    return key.astype("<u8").tobytes() + count.astype("<i8").tobytes()


def with_ends(ids: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words with an end behind each text, the context of each, text of each)."""
    sizes = np.diff(np.concatenate([[0], ends]))
    after = np.cumsum(sizes + 1)
    words = np.full(after[-1] if len(after) else 0, end_id)
    inside = np.ones(len(words), bool)
    inside[after - 1] = False
    words[inside] = ids
    context = np.concatenate([[end_id], words[:-1]])[: len(words)]
    return words, context, np.repeat(np.arange(len(sizes)), sizes + 1)


def pair_keys(context: np.ndarray, words: np.ndarray) -> np.ndarray:
    return context.astype(np.uint64) << np.uint64(32) | words.astype(np.uint64)


def count_pairs(spark: SparkSession, docs: DataFrame, trie: Trie, folder: str, strength: float) -> None:
    """The second level, added to the trie."""
    buckets = bucket_count(docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter()
        for batch in batches:
            for _, texts in blocks(batch.column("text")):
                words, codes, ends = word_codes(texts)
                known, _, _ = trie.look_up(np.append(hashes(words), END))
                sequence, context, _ = with_ends(known[:-1][codes], ends, int(known[-1]))
                if counter.add(*summed([pair_keys(context, sequence)], [np.ones(len(sequence), np.int64)])):
                    yield counter.blobs(hash_of, buckets)
        yield counter.blobs(hash_of, buckets)

    def merge(bucket: int, blobs: list[bytes]) -> Iterator[pd.DataFrame]:
        pair, count = _read_blobs(blobs)
        context, word = (pair >> np.uint64(32)).astype(np.int64), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])[: len(context)])
        sizes = np.diff(np.append(first, len(pair)))
        total, _ = trie.of_ids(context[first])
        distinct, which = np.unique(word, return_inverse=True)
        unigram = 10.0 ** trie.of_ids(distinct)[1][which]
        p = np.log10((count + strength * unigram) / (np.repeat(total, sizes) + strength))
        last = word[first + sizes - 1] + 1
        begin = np.repeat(np.cumsum(last) - last, sizes)
        pointers = np.append(first, len(pair))
        sequences = {
            "contexts": elias_fano.encode(context[first], trie.words),
            "pointers": elias_fano.encode(pointers, len(pair) + 1),
            "followers": elias_fano.encode(begin + word, int(last.sum())),
        }
        path = elias_fano.write(f"{folder}/pairs", f"pairs-{bucket:06d}", sequences, codes=quantised(p))
        yield pd.DataFrame({"bucket": [bucket], "path": [path], "n": [len(pair)]})

    packed = docs.select("text").mapInArrow(count, "bucket int, blob binary")
    files = _manifest(per_bucket(packed, merge, "bucket int, path string, n long"), f"{folder}/pairs-files")
    trie.pair_buckets, trie.pair_paths = buckets, {r["bucket"]: r["path"] for r in files}


def train(spark: SparkSession, docs: DataFrame, folder: str, strength: float = STRENGTH) -> Trie:
    """The trie of all texts of ``docs``."""
    chosen = docs.select(F.col("text").cast("string"))
    trie = count_words(chosen, folder)
    if trie.words:
        count_pairs(spark, chosen, trie, folder, strength)
    return trie


# ---- scores -------------------------------------------------------------------------------------------------


def score(docs: DataFrame, trie: Trie, strength: float = STRENGTH) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale = trie.tokens + 0.5 * (trie.words + 1)
        for batch in batches:
            for at, texts in blocks(batch.column("text")):
                words, codes, ends = word_codes(texts)
                ids, counts, p = trie.look_up(np.append(hashes(words), END))
                local = len(words)  # the end's place among them
                word, context, text = with_ends(codes, ends, local)
                base = np.log10((counts + 0.5) / scale)[word]
                share = np.log10(strength / (counts + strength))
                best = p[word] + share[context]
                known = ids >= 0
                both = np.flatnonzero(known[word] & known[context])
                if len(both) and trie.pair_paths:
                    pair = pair_keys(ids[context[both]], ids[word[both]])
                    order = np.argsort(pair, kind="stable")
                    new = np.concatenate([[True], pair[order][1:] != pair[order][:-1]])
                    found = np.empty(len(pair))
                    found[order] = trie.pairs(pair[order][new])[np.cumsum(new) - 1]
                    seen = ~np.isnan(found)
                    best[both[seen]] = found[seen]
                n = len(ends)
                columns = [batch.column("doc_id").slice(at, n), *(pa.array(np.bincount(text, w, n).astype(kind)) for w, kind in ((None, np.int64), (known[word], np.int64), (base, np.float64), (best, np.float64)))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCORES)


def held_out() -> Column:
    return F.coalesce(crc32_mod5() == 1, F.lit(False))


def digest(scored: DataFrame, trie: Trie) -> DataFrame:
    return scored.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(trie.tokens).cast("long").alias("train_tokens"), "base_score", "score")
