"""Passages of benchmark items in documents, edits allowed.

An item leaks into a document that holds a passage within ``share * length`` edits (insertions, deletions, substitutions of
characters; ASCII letters in either case and any white space agree). Windows of a document start at every character.

1. A window can only be that near an item if it shares enough q-grams with it (one edit spoils q of them), each at most as many
   places off as there are edits. Places where no item has that many are not looked at further. This bound loses nothing.
2. The CGK walk maps a window to a sequence of characters: step j writes the character at the pointer and, by a random bit
   of (j, character), moves the pointer on or not. Few edits then cost few positions (Hamming distance), as two
   walks that were thrown apart meet again. The longer the walk, the longer they stay apart; so the walks of a long item
   go over windows of at most ``WINDOW`` characters, spread over the item, each from its own place in it.
3. Bit sampling: a table's key is the characters at ``sampled`` random positions. A start whose key is that of an item in any
   of several tables of several walks is a candidate. Each group of items of like length has as many walks as find ``RECALL`` of
   its own items again, edited at random by the largest number of edits, but at most ``MOST_WALKS`` (``Group.recall``: the share found).
4. Candidates are verified by the exact edit distance (bit-parallel search of the item around the start).

Null or empty items and texts match nothing. Items of equal text are reported each. Null ids are kept as they are; repeated rows are searched each. The items are sent to the
tasks in blocks of at most ``BLOCK_ITEMS`` rows and ``BLOCK_ITEM_CHARS`` characters; more items take more passes over the documents.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.llm.shared import give_back
from tradewind.llm.words import blocks

SHARE = 0.1
WALKS = 8  # at first
MOST_WALKS = 64
TABLES = 8  # of each walk and group of lengths
SAMPLED = 5
WINDOW = 120  # characters of an item that a walk goes over
RECALL = 0.97
TRIALS = 60  # edited items by which the recall of a group is measured
BLOCK_ITEMS = 5_000
BLOCK_ITEM_CHARS = 4_000_000
BLOCK_CHARS = 4_000_000
STARTS_AT_ONCE = 100_000
FOUND = "doc_id long, item_id long, edits int, start long, end long"

_BITS = 21
_SPACES = [9, 10, 11, 12, 13, 0x85, 0xA0, 0x2028, 0x2029, 0x3000]
_EVEN = np.arange(0x110000, dtype=np.uint32)
_EVEN[65:91] += 32
_EVEN[_SPACES] = 32


def symbols(text: str) -> np.ndarray:
    """Code points, a character each, case and kind of white space evened out."""
    return _EVEN[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def grams(x: np.ndarray, q: int) -> np.ndarray:
    """A hash of the q symbols from each position on; the last q - 1 reach over the end."""
    h = x.astype(np.uint32) * np.uint32(0x9E3779B1)
    out, have, power = np.zeros_like(h), 0, h
    width, bits = 1, q
    while bits:  # sums of powers of two
        if bits & 1:
            out = _shifted(power, have) * np.uint32(0x85EBCA6B) + (out ^ (out >> np.uint32(15))) * np.uint32(0xC2B2AE35)
            have += width
        bits >>= 1
        if bits:
            power = (power ^ (power >> np.uint32(13))) * np.uint32(0x27D4EB2F) + _shifted(power, width) * np.uint32(0x165667B1)
            width *= 2
    return (out ^ (out >> np.uint32(16))) * np.uint32(0x7FEB352D)


def _shifted(x: np.ndarray, by: int) -> np.ndarray:
    return x if by == 0 else np.concatenate([x[by:], np.zeros(min(by, len(x)), x.dtype)])


def gram_bound(m: int, share: float) -> tuple[int, int]:
    """(q, shared q-grams at least) for an item of length m: the longest q that leaves a useful number."""
    e = int(share * m)
    for q in (8, 7, 6, 5, 4, 3, 2):
        if q <= m and (least := m - q + 1 - q * e) >= 3:
            return q, least
    return 1, m - e


@dataclass
class Group:
    """Items of like length."""

    shortest: int
    places: list[int] = field(default_factory=list)  # by walk: where in an item it starts
    taps: list[np.ndarray] = field(default_factory=list)  # by walk: table, sampled: steps
    keys: list[list[tuple[np.ndarray, np.ndarray]]] = field(default_factory=list)  # by walk and table: sorted keys, their items
    recall: float = 0.0


class Items:
    """What tasks need of a block of items."""

    def __init__(self, rows: list[tuple[int | None, str]], share: float = SHARE, walks: int = WALKS, tables: int = TABLES, sampled: int = SAMPLED):
        self.share = share
        self.ids = [i for i, t in rows if t]
        self.texts = [symbols(t) for _, t in rows if t]
        self.patterns: dict[int, dict[int, int]] = {}
        rng = np.random.default_rng(11)
        self.odd = rng.integers(0, 2**31, 64, np.uint32) * np.uint32(2) + np.uint32(1)
        self.groups: list[Group] = []
        place: dict[int, Group] = {}
        members: dict[int, list[int]] = defaultdict(list)
        postings: dict[int, list[np.ndarray]] = defaultdict(list)  # by q: hash, item, place
        self.bounds = np.zeros((len(self.texts), 2), np.int64)  # edits, shared q-grams
        for k, x in enumerate(self.texts):
            q, least = gram_bound(len(x), share)
            self.bounds[k] = int(share * len(x)), least
            h = grams(x, q)[: len(x) - q + 1]
            postings[q].append(np.stack([h.astype(np.int64), np.full(len(h), k), np.arange(len(h))]))
            key = int(np.log(len(x)) / np.log(1.25))
            if key not in place:
                place[key] = Group(len(x))
                self.groups.append(place[key])
            g = place[key]
            g.shortest = min(g.shortest, len(x))
            members[id(g)].append(k)
        self.group_of = {k: n for n, g in enumerate(self.groups) for k in members[id(g)]}
        self.postings = {}
        for q, parts in postings.items():
            hash_, item, offset = (c[np.argsort(np.concatenate(parts, axis=1)[0], kind="stable")] for c in np.concatenate(parts, axis=1))
            known = np.zeros(1 << _BITS, bool)
            known[hash_ >> (32 - _BITS)] = True
            self.postings[q] = known, hash_.astype(np.uint32), item, offset
        self.gap = 2 * WINDOW  # more than a walk's steps
        for g in self.groups:
            self._add_walks(g, np.array(members[id(g)]), walks, tables, sampled, rng)

    def _add_walks(self, g: Group, mine: np.ndarray, walks: int, tables: int, sampled: int, rng: np.random.Generator) -> None:
        """Walks of a group, doubled until they find enough of its edited items."""
        x, starts = self._joined([self.texts[k] for k in mine])
        tried = rng.choice(len(mine), TRIALS)
        edits = self.bounds[mine[tried], 0]
        y, first = self._joined([_edited(self.texts[mine[n]], e, rng) for n, e in zip(tried, edits)])
        trial = np.repeat(np.arange(TRIALS), 2 * edits + 1)
        near = np.arange(len(trial)) - np.repeat(np.cumsum(2 * edits + 1) - edits - 1, 2 * edits + 1) + first[trial]
        found = np.zeros(TRIALS, bool)
        window = min(WINDOW, g.shortest)
        while True:
            for w in range(len(g.taps), walks):
                # Spread evenly, whatever the number of walks. The pointer moves on at every other step, so a window lasts for about twice its length.
                g.places.append(int((w * 0.6180339887498949) % 1 * (g.shortest - window + 1)))
                g.taps.append(np.sort(rng.integers(0, max(2, int(1.7 * window)), (tables, sampled)), axis=1))
                g.keys.append([])
                keys = self.walk_keys(x, starts + g.places[w], w, g)
                tries = self.walk_keys(y, near + g.places[w], w, g)
                for key, other in zip(keys, tries):
                    found[trial[key[tried[trial]] == other]] = True
                    order = np.argsort(key, kind="stable")
                    g.keys[w].append((key[order], mine[order]))
            g.recall = float(found.mean())
            if g.recall >= RECALL or 2 * walks > MOST_WALKS:
                return
            walks *= 2

    def _joined(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The texts with gaps between them, and where each starts."""
        gap = np.zeros(self.gap, np.uint32)
        sizes = np.array([len(t) + self.gap for t in texts], np.int64)
        return np.concatenate([gap, *(part for t in texts for part in (t, gap))]), self.gap + np.cumsum(sizes) - sizes

    def walk_keys(self, x: np.ndarray, starts: np.ndarray, walk: int, g: Group) -> list[np.ndarray]:
        """The keys of each table of the group's walk from each start."""
        taps: dict[int, list[int]] = defaultdict(list)
        for t, steps in enumerate(g.taps[walk].tolist()):
            for s in steps:
                taps[s].append(t)
        out = [np.zeros(len(starts), np.uint64) for _ in g.taps[walk]]
        last = len(x) - 1
        pointer = np.clip(starts.astype(np.int64), 0, last)
        for step in range(max(taps, default=-1) + 1):
            here = x[pointer]
            for t in taps.get(step, ()):
                key = out[t]
                key *= np.uint64(0x100000001B3)
                key += here.astype(np.uint64)
                key ^= key >> np.uint64(29)
            bit = (here * self.odd[(step + 17 * walk) % 64] + np.uint32((step * 0x9E3779B1 + walk * 0x7F4A7C15) & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B) >> np.uint32(31)
            pointer = np.minimum(pointer + bit, last)
        return out

    # ---- search --------------------------------------------------------------------------------------------

    def search(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(number of the text, number of the item, edits, start, end): the nearest passage of each text and item."""
        if not texts or not self.groups:
            return []
        parts = [symbols(t) for t in texts]
        x, begins = self._joined(parts)
        bounds = [(a, a + len(p)) for a, p in zip(begins.tolist(), parts)]
        pairs: dict[tuple[int, int], list[int]] = defaultdict(list)
        for g, starts in self.windows(x):
            for lo in range(0, len(starts), STARTS_AT_ONCE):
                some = starts[lo : lo + STARTS_AT_ONCE]
                for w, place in enumerate(g.places):
                    text_of = np.maximum(np.searchsorted(begins, some + place, "right") - 1, 0)
                    for keys, (known, items) in zip(self.walk_keys(x, some + place, w, g), g.keys[w]):
                        first, end = np.searchsorted(known, keys, "left"), np.searchsorted(known, keys, "right")
                        for r in np.flatnonzero(first < end).tolist():
                            for k in items[first[r] : end[r]].tolist():
                                pairs[int(text_of[r]), k].append(int(some[r]))
        out = []
        for (n, k), at in sorted(pairs.items()):
            best = None
            m, (a, b) = len(self.texts[k]), bounds[n]
            slack = int(self.share * m) + 1
            for lo, hi in _runs(sorted(set(at)), m):
                lo, hi = max(a, lo - slack), min(b, hi + m + slack)
                if lo < hi and (hit := self.verify(x[lo:hi], k)) and (best is None or hit[0] < best[0]):
                    best = (hit[0], lo + hit[1] - a, lo + hit[2] - a)
            if best:
                out.append((n, k, *best))
        return out

    def windows(self, x: np.ndarray) -> list[tuple[Group, np.ndarray]]:
        """By group, the starts at which an item of it may lie by the bound of step 1."""
        starts: list[list[np.ndarray]] = [[] for _ in self.groups]
        for q, (known, hashes, item, offset) in self.postings.items():
            h = grams(x, q)
            at = np.flatnonzero(known[h >> np.uint32(32 - _BITS)])
            first, end = np.searchsorted(hashes, h[at], "left"), np.searchsorted(hashes, h[at], "right")
            times = end - first
            entry = np.repeat(first - np.cumsum(times) + times, times) + np.arange(times.sum())
            k, diagonal = item[entry], np.repeat(at, times) - offset[entry]
            order = np.argsort(k * (2 * len(x) + 2**21) + diagonal + 2**20, kind="stable")
            k, diagonal = k[order], diagonal[order]
            edits, least = self.bounds[k].T
            # Enough q-grams on so few diagonals that one start is within ``edits`` of all of them.
            j = np.arange(len(k)) + least - 1
            inside = j < len(k)
            j = np.minimum(j, max(0, len(k) - 1))
            hit = np.flatnonzero(inside & (k[j] == k) & (diagonal[j] - diagonal <= 2 * edits))
            low, high = diagonal[j[hit]] - edits[hit], diagonal[hit] + edits[hit]
            wide = high - low + 1
            one = np.repeat(low - np.cumsum(wide) + wide, wide) + np.arange(wide.sum())
            group = np.repeat(np.array([self.group_of[n] for n in k[hit].tolist()], np.int64), wide)
            for n in range(len(self.groups)):
                starts[n].append(one[group == n])
        found = [np.unique(np.concatenate([*s, np.empty(0, np.int64)])) for s in starts]
        return list(zip(self.groups, found))

    def verify(self, x: np.ndarray, k: int) -> tuple[int, int, int] | None:
        """(edits, start, end) of the nearest passage in x, if it is near enough; the first of equally near ones."""
        item = self.texts[k]
        most = int(self.share * len(item))
        edits, end = nearest_end(x.tolist(), self._masks(k, item), len(item))
        if edits > most:
            return None
        back, size = nearest_end(x[:end][::-1].tolist(), self._masks(~k, item[::-1]), len(item), anchored=True)
        return edits, end - size, end

    def _masks(self, k: int, item: np.ndarray) -> dict[int, int]:
        if k not in self.patterns:
            masks: dict[int, int] = defaultdict(int)
            for i, s in enumerate(item.tolist()):
                masks[s] |= 1 << i
            self.patterns[k] = dict(masks)
        return self.patterns[k]


def _edited(x: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    """With so many random edits, by symbols of its own."""
    out = x.tolist()
    for how in rng.integers(0, 3, edits).tolist():
        at = int(rng.integers(0, len(out) + (how == 2)))
        out[at : at + (how != 2)] = [] if how == 1 else [int(x[rng.integers(0, len(x))])]
    return np.array(out, np.uint32)


def _runs(at: list[int], reach: int) -> list[tuple[int, int]]:
    out = [[at[0], at[0]]]
    for a in at[1:]:
        if a - out[-1][1] > reach:
            out.append([a, a])
        out[-1][1] = a
    return [(a, b) for a, b in out]


def nearest_end(text: list[int], masks: dict[int, int], m: int, anchored: bool = False) -> tuple[int, int]:
    """(edits, end) of the passage nearest to a pattern of length m; anchored: of the prefix (Myers' bit-parallel recurrence)."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for j, s in enumerate(text, 1):
        eq = masks.get(s, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | (full & ~(xh | plus)), plus & xh
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = up << 1 | anchored
        down <<= 1
        plus, minus = (down | ~(xv | up)) & full, up & xv & full
        if score < best:
            best, end = score, j
    return best, end


# ---- Spark -------------------------------------------------------------------------------------------------


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    """The items, at most ``BLOCK_ITEMS`` rows and about ``BLOCK_ITEM_CHARS`` characters in the driver at a time."""
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("length(text) > 0").orderBy("item_id", "text")
    block, chars = [], 0
    for r in rows.toLocalIterator():
        if block and (len(block) >= BLOCK_ITEMS or chars + len(r["text"]) > BLOCK_ITEM_CHARS):
            yield block
            block, chars = [], 0
        block.append((r["item_id"], r["text"]))
        chars += len(r["text"])
    if block:
        yield block


def _blocks(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of a bounded number of bytes, or one text; a batch's texts are never all at hand as Python strings."""
    for at, some in blocks(texts, BLOCK_CHARS):
        yield at, some.to_pylist()


def leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, edits, start, end) of every leaked item; offsets in characters, end exclusive."""
    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = spark.createDataFrame([], FOUND)
    for block in item_blocks(benchmark):
        shared = spark.sparkContext.broadcast(Items(block, share))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            give_back()  # what an earlier task of this worker left
            items = shared.value
            for batch in batches:
                ids = batch.column("doc_id")
                for at, texts in _blocks(batch.column("text")):
                    found = items.search(texts)
                    columns = list(zip(*found)) or [[]] * 5
                    rows = [ids.take(pa.array([at + n for n in columns[0]], pa.int64())), pa.array([items.ids[k] for k in columns[1]], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int64())]
                    yield pa.RecordBatch.from_arrays(rows, ["doc_id", "item_id", "edits", "start", "end"])

        out = out.unionAll(chosen.mapInArrow(run, FOUND))
    return out


def without_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """The rows of ``docs`` into which no item leaked, with their own columns; nothing is joined."""
    for block in item_blocks(benchmark):
        shared = spark.sparkContext.broadcast(Items(block, share))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            give_back()
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for at, texts in _blocks(batch.column("text")):
                    keep[[at + n for n, *_ in shared.value.search(texts)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
