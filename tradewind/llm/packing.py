"""Packing documents into sequences by bin completion.

Pieces of equal length are alike to a packer, so the search runs on the number of pieces of each length: at most
``capacity`` numbers, whatever the size of the corpus. Only these reach the driver. A step takes the longest length left,
finds the fillings of the rest of its bin that waste least, and uses one as often as the counts allow; so it ends a length
or nearly so, and there are about as many steps as lengths. The first descent, which always takes the best fit, is the first
incumbent. Others follow with a different filling at one of the steps, are cut off as soon as the bins used and the bound
on the rest reach the incumbent's number, and end when the incumbent meets the bound. ``descents`` bounds the search, never the pieces.

Fillings: only lengths whose sum is the largest that fits are listed (others are dominated), larger lengths first
(a single length dominates the shorter ones that sum to it).

Null or empty text: one piece, the end id alone. Null doc_ids and repeated doc_ids are packed like others, a set of pieces for every row.
No documents: no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradewind.llm.shared import few, stored
from tradewind.llm.tokenizing import BLOCK_CHARS, CACHE_WORDS, encoder

PIECES = "doc_id long, piece int, start long, length int, ids binary, part int, place long"
Pattern = tuple[int, tuple[tuple[int, int], ...]]  # how often; (length, times) in a bin


# ---- the search, on counts by length --------------------------------------------------------------------


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Bins needed at least: by volume, and with the lengths over half a bin each in one of their own (Martello and Toth's L2)."""
    total = sum(n * c for n, c in counts.items())
    best = -(-total // capacity)
    for k in sorted({n for n in counts if 2 * n <= capacity} | {0}):
        large = sum(c for n, c in counts.items() if n > capacity - k)
        middle = sum(c for n, c in counts.items() if capacity - k >= n > capacity / 2)
        room = sum((capacity - n) * c for n, c in counts.items() if capacity - k >= n > capacity / 2)
        small = sum(n * c for n, c in counts.items() if k <= n <= capacity / 2)
        best = max(best, large + middle + max(0, -(-(small - room) // capacity)))
    return best


def fillings(counts: dict[int, int], room: int, most: int) -> list[tuple[tuple[int, int], ...]]:
    """Up to ``most`` ways to fill ``room`` with the largest sum that fits, larger lengths first."""
    lengths = sorted(n for n, c in counts.items() if c > 0 and n <= room)
    mask = (1 << (room + 1)) - 1
    reach = [1]  # bit s of reach[k]: sum s can be made of the k shortest lengths
    for n in lengths:
        bits, left, step = reach[-1], min(counts[n], room // n), 1
        while left:
            use = min(step, left)
            bits |= (bits << (n * use)) & mask
            left, step = left - use, 2 * step
        reach.append(bits)
    found: list[tuple[tuple[int, int], ...]] = []

    def descend(k: int, rest: int, chosen: tuple[tuple[int, int], ...]) -> None:
        if rest == 0:
            found.append(chosen)
            return
        if k == 0:
            return
        n = lengths[k - 1]
        for use in range(min(counts[n], rest // n), -1, -1):
            if len(found) >= most:
                return
            if reach[k - 1] >> (rest - use * n) & 1:
                descend(k - 1, rest - use * n, (*chosen, (n, use)) if use else chosen)

    descend(len(lengths), reach[-1].bit_length() - 1, ())
    return found


def complete(counts: dict[int, int], capacity: int, descents: int = 24, width: int = 3) -> list[Pattern]:
    """Patterns that use every piece once, in as few bins as the search finds."""
    goal = lower_bound(counts, capacity)
    best: list[Pattern] = []
    best_bins = sum(counts.values()) + 1

    def run(kept: list[Pattern], to: int) -> None:
        """A descent below the bins ``kept``, with filling ``to`` at its first step and the best fit at all others."""
        nonlocal best, best_bins
        left, made, choice = dict(counts), [], to
        for times, bin_ in kept:
            for n, use in bin_:
                left[n] -= times * use
            made.append((times, bin_))
        bins, volume = sum(times for times, _ in kept), sum(n * c for n, c in left.items())
        for n in sorted(counts, reverse=True):
            while left[n]:
                left[n] -= 1
                options = fillings(left, capacity - n, choice + 1)
                chosen, choice = options[min(choice, len(options) - 1)], 0
                left[n] += 1
                uses = defaultdict(int, {n: 1})
                for m, use in chosen:
                    uses[m] += use
                times = min(left[m] // use for m, use in uses.items())
                for m, use in uses.items():
                    left[m] -= times * use
                    volume -= times * use * m
                made.append((times, tuple(uses.items())))
                bins += times
                if bins + -(-volume // capacity) >= best_bins:
                    return
        best, best_bins = made, bins

    run([], 0)
    first = best
    for i in range(descents):
        if best_bins <= goal:
            break
        # The last choices first: there the waste arises, and a change leaves most of the first descent as it is.
        run(first[: max(0, len(first) - 2 - 2 * (i // (width - 1)))], 1 + i % (width - 1))
    return best


# ---- Spark -------------------------------------------------------------------------------------------


def pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int = 2, words: int = CACHE_WORDS, chars: int = BLOCK_CHARS) -> DataFrame:
    """Pieces with their ids, and the place of each among the pieces of its length in its task.

    Only documents longer than ``capacity`` are cut; the first piece takes what does not fill a whole one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, end = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), int(end_id).to_bytes(4, "little")
        for batch in batches:
            doc_ids = batch.column("doc_id")
            for at, tokens, sizes in encoder(vocabulary, words, chars).encode(batch.column("text")):
                raw, stop, rows = tokens.tobytes(), 0, []
                for row, n in enumerate(sizes.tolist(), at):
                    content = raw[4 * stop : 4 * (stop + n)] + end
                    first = (n + 1) % capacity or capacity
                    cuts = [0, *range(first, n + 2, capacity)] if n + 1 > capacity else [0, n + 1]
                    rows += [(row, k, i, j - i, content[4 * i : 4 * j]) for k, (i, j) in enumerate(zip(cuts, cuts[1:]))]
                    stop += n
                row, piece, start, length, ids = zip(*rows)
                length = np.array(length, np.int64)
                order = np.argsort(length, kind="stable")
                counts = np.bincount(length, minlength=capacity + 1)
                place = np.empty(len(length), np.int64)
                place[order] = np.arange(len(length)) - np.repeat(np.cumsum(counts) - counts, counts)
                place += seen[length]
                seen += counts
                columns = [doc_ids.take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(ids, pa.binary()), pa.array(np.full(len(row), part), pa.int32()), pa.array(place)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids", "part", "place"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def pack(spark: SparkSession, docs: DataFrame, folder: str, vocabulary: str, capacity: int = 1024, end_id: int = 2, descents: int = 24, words: int = CACHE_WORDS, chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, piece, start, length, ids, sequence_id, offset) per piece.

    ``words`` and ``chars`` bound what a worker keeps and what it encodes at a time; neither changes a result.
    The pieces are stored once. Their numbers by task and length give each piece its rank among all of its length
    without bringing a length together; patterns (a few per length) tell from the rank which sequence it goes to.
    """
    cut = stored(pieces(docs, vocabulary, capacity, end_id, words, chars), f"{folder}/pieces")
    by_task = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranks = by_task.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    slots = _slots(complete(counts, capacity, descents))

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            sequence, offset = np.empty(len(p), np.int64), np.empty(len(p), np.int64)
            length, rank = p["length"].to_numpy(), p["rank"].to_numpy()
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                first, sequence0, per_bin, offset0 = slots[int(n)]
                k = np.searchsorted(first, rank[at], "right") - 1
                inside = rank[at] - first[k]
                sequence[at] = sequence0[k] + inside // per_bin[k]
                offset[at] = offset0[k] + inside % per_bin[k] * n
            yield p.drop(columns="rank").assign(sequence_id=sequence, offset=offset)

    # At most ``capacity`` rows a task: small beside the pieces, which are only shuffled where it is too large to be sent to all.
    ranked = cut.join(few(ranks), ["part", "length"]).select("doc_id", "piece", "start", F.col("length").cast("long"), "ids", (F.col("place") + F.col("before")).alias("rank"))
    return ranked.mapInPandas(place, "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long")


def _slots(patterns: list[Pattern]) -> dict[int, list[np.ndarray]]:
    """By length, for each pattern that uses it: first rank, first sequence, pieces of it per sequence, offset of the first of them."""
    out: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    sequence = 0
    for times, bin_ in patterns:
        offset = 0
        for n, use in bin_:
            out[n].append((used[n], sequence, use, offset))
            used[n] += times * use
            offset += n * use
        sequence += times
    return {n: [np.array(c, np.int64) for c in zip(*rows)] for n, rows in out.items()}


def digest(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
