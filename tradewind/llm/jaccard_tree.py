"""Near-duplicate documents: exact Jaccard join of word shingles by signature trees.

What cannot link is put aside first, exactly: a document links only if three quarters of its shingles stand in other
documents too (``sizes``). Equal sets become one node. A node's shingles are ordered from the rarest; two sets that
link share one of the first quarter of each (``prefixes``), so links lie within the components of shared first shingles.

Within such a component a signature tree (``Tree``) holds the sets in blocks: a leaf has a bitmap of its shingles and its size, a node
the OR of its children's bitmaps and the range of their sizes. Two trees are walked at once. A pair of nodes is left if the largest overlap
that bitmaps and sizes allow is too small, or if all sets below both are joined already. Leaves are compared exactly.

A component of several blocks is searched block by block; then a set of each block's largest group is compared
across blocks, which joins what belongs together; then only sets outside the component's largest group are compared with all blocks.

Whatever is sent by shingle is first combined in blocks of documents, so a shingle in a third of all documents
is one row a block.

Null or empty texts, and those without words: no shingles, linked with nothing. Null doc_ids: linked like others, but never a component's id, which is
null only if no member has an id. Repeated rows: each counts; rows with equal text link.
"""

from __future__ import annotations

import hashlib
import struct
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.llm.graph import components, contracted
from tradewind.llm.shared import bucket_count, by_bucket, few, give_back, per_bucket, stored, unused
from tradewind.llm.words import blocks, shingles

WORDS = 5
NO_ID = np.iinfo(np.int64).min
SIGNATURE_BITS = 2048
FANOUT = 8
BLOCK_SETS = 4096
HEAD = "<IIII"


def near(overlap: int, a: int, b: int) -> bool:
    """100 * overlap >= 75 * union."""
    return 7 * overlap >= 3 * (a + b)


# ---- which documents can link ------------------------------------------------------------------------------


def packed_shingles(docs: DataFrame, words: int, buckets: int) -> DataFrame:
    """Rows (bucket, blob) of (doc_id, text). Per block of texts, a shingle that several of them have is sent once, marked, and is
    counted for these here; a shingle that one has is sent with that document. Documents' sizes travel with the bucket of their number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for at, texts in blocks(batch.column("text")):
                sets = shingles(texts, words)
                mine, size = ids[at : at + len(sets)], np.array([len(s) for s in sets])
                key, doc = np.concatenate([*sets, np.empty(0, np.uint64)]), np.repeat(np.arange(len(sets)), size)
                order = np.argsort(key, kind="stable")
                key, doc = key[order], doc[order]
                first = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
                last = np.concatenate([first[1:], [True]])[: len(key)]
                single = first & last
                several = np.bincount(doc[~single], minlength=len(sets))
                marked = key[first & ~single]
                key, doc = key[single], doc[single]
                meta = {b: at for b, at in by_bucket(np.arange(len(sets)) % buckets, buckets)}
                once, more = dict(by_bucket(_bucket(key, buckets), buckets)), dict(by_bucket(_bucket(marked, buckets), buckets))
                rows = []
                for b in sorted({*meta, *once, *more}):
                    o, m, d = once.get(b, order[:0]), more.get(b, order[:0]), meta.get(b, order[:0])
                    o = o[np.argsort(doc[o], kind="stable")]
                    used, counts = np.unique(doc[o], return_counts=True)
                    parts = [mine[used].astype("<i8"), counts.astype("<u4"), key[o].astype("<u4"), marked[m].astype("<u4"), mine[d].astype("<i8"), size[d].astype("<u4"), several[d].astype("<u4")]
                    rows.append((b, struct.pack(HEAD, len(used), len(o), len(m), len(d)) + b"".join(p.tobytes() for p in parts)))
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["bucket", "blob"])

    return docs.mapInArrow(run, "bucket int, blob binary")


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _sections(blob: bytes) -> list[np.ndarray]:
    used, once, marked, meta = struct.unpack_from(HEAD, blob)
    out, at = [], struct.calcsize(HEAD)
    for kind, n in (("<i8", used), ("<u4", used), ("<u4", once), ("<u4", marked), ("<i8", meta), ("<u4", meta), ("<u4", meta)):
        out.append(np.frombuffer(blob, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def count_shared(_: int, blobs: list[bytes]) -> Iterator[pd.DataFrame]:
    """Of each document, how many of the bucket's shingles stand elsewhere too. Two shingles that agree in the bits sent count as shared, which only keeps more documents."""
    parts = [_sections(b) for b in blobs]
    ids, counts, once, marked, docs, size, several = (np.concatenate(c) for c in zip(*parts))
    key = np.concatenate([once, marked])
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    same = ordered[1:] == ordered[:-1]
    twice = np.zeros(len(key), bool)
    twice[order] = np.concatenate([[False], same])[: len(key)] | np.concatenate([same, [False]])[: len(key)]
    owner = np.repeat(np.arange(len(ids)), counts)
    # A marked shingle counts for what other blocks send alone; its own block has counted it.
    shared = np.bincount(owner[twice[: len(once)]], minlength=len(ids))
    hit = shared > 0
    yield pd.DataFrame({"doc_id": np.concatenate([ids[hit], docs]), "n": np.concatenate([np.zeros(hit.sum(), np.int64), size]), "shared": np.concatenate([shared[hit], several]), "times": np.concatenate([np.zeros(hit.sum(), np.int64), np.ones(len(docs), np.int64)])})


def sizes(docs: DataFrame, folder: str, words: int) -> DataFrame:
    """(doc_id, n, shared, times) by doc_id; times: its rows."""
    packed = packed_shingles(docs, words, bucket_count(docs))
    counted = per_bucket(packed, count_shared, "doc_id long, n long, shared long, times long")
    return stored(counted.groupBy("doc_id").agg(F.sum("n").alias("n"), F.sum("shared").alias("shared"), F.sum("times").alias("times")), f"{folder}/sizes")


# ---- nodes: distinct sets -----------------------------------------------------------------------------------


def sets_of(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in blocks(batch.column("text")):
                raw = [s.astype("<u8").tobytes() for s in shingles(texts, words)]
                nodes = [hashlib.md5(r, usedforsecurity=False).hexdigest() if r else None for r in raw]
                columns = [batch.column("doc_id").slice(at, len(raw)), pa.array([len(r) // 8 for r in raw], pa.int64()), pa.array(nodes, pa.string()), pa.array(raw, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "node", "shingles"])

    return docs.mapInArrow(run, "doc_id long, n long, node string, shingles binary")


def distinct_sets(sets: DataFrame, folder: str) -> DataFrame:
    """(number, block, node, n, shingles, rep): each set once, with the smallest doc_id that has it. Copies are combined before they are shuffled."""
    known = F.when(F.col("doc_id") != NO_ID, F.col("doc_id"))
    one = sets.where("node IS NOT NULL").groupBy("node").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles"), F.min(known).alias("rep"))
    number = F.monotonically_increasing_id()
    return stored(one.select(number.alias("number"), F.shiftright(number, 11).alias("block"), "*"), f"{folder}/nodes")


# ---- first shingles -------------------------------------------------------------------------------------------


def by_block(rows: DataFrame, sort: list[str], work, schema: str) -> DataFrame:
    """``work`` on all rows of a block at a time, as (block, frame)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for part in parts:
            for block, some in part.groupby("block", sort=False):
                if held and held[0]["block"].iloc[0] != block:
                    yield from work(int(held[0]["block"].iloc[0]), pd.concat(held))
                    held = []
                held.append(some)
        if held:
            yield from work(int(held[0]["block"].iloc[0]), pd.concat(held))
        held = []
        give_back()

    return rows.repartition("block").sortWithinPartitions("block", *sort).mapInPandas(run, schema)


def prefixes(nodes: DataFrame, folder: str) -> DataFrame:
    """Edges (a, b) that join all nodes which have a first shingle in common, as stars."""
    buckets = bucket_count(nodes)

    def ask(block: int, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        key, count = np.unique(np.concatenate([np.frombuffer(r, "<u8") for r in rows["shingles"]]), return_counts=True)
        out = [(b, struct.pack("<q", block) + key[at].tobytes() + count[at].astype("<u4").tobytes()) for b, at in by_bucket(_bucket(key, buckets), buckets)]
        yield pd.DataFrame(out, columns=["bucket", "blob"])

    def answer(_: int, blobs: list[bytes]) -> Iterator[pd.DataFrame]:
        asked = [(int.from_bytes(b[:8], "little", signed=True), len(b[8:]) // 12, b) for b in blobs]
        key = np.concatenate([np.frombuffer(b, "<u8", n, 8) for _, n, b in asked])
        count = np.concatenate([np.frombuffer(b, "<u4", n, 8 + 8 * n) for _, n, b in asked]).astype(np.int64)
        distinct, which = np.unique(key, return_inverse=True)
        total = np.bincount(which, count)[which].astype(np.int64)
        ends = np.cumsum([n for _, n, _ in asked])
        out = []
        for (block, n, _), end in zip(asked, ends.tolist()):
            some = np.flatnonzero(total[end - n : end] > 1) + end - n
            if len(some):
                out.append((block, None, None, key[some].tobytes() + np.minimum(total[some], 2**32 - 1).astype("<u4").tobytes()))
        yield pd.DataFrame(out, columns=["block", "number", "n", "shingles"]).astype({"number": "Int64", "n": "Int64"})

    def choose(block: int, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        replies = rows["shingles"][rows["number"].isna()]
        if not len(replies):
            return
        shared = np.concatenate([np.frombuffer(r, "<u8", len(r) // 12) for r in replies])
        total = np.concatenate([np.frombuffer(r, "<u4", len(r) // 12, len(r) // 12 * 8) for r in replies])
        order = np.argsort(shared)
        shared, total = shared[order], total[order]
        keys, owners = [], []
        mine = rows[rows["number"].notna()]
        for number, raw in zip(mine["number"].tolist(), mine["shingles"]):
            key = np.frombuffer(raw, "<u8")
            at = np.minimum(np.searchsorted(shared, key), len(shared) - 1)
            hit = shared[at] == key
            alone = len(key) - int(hit.sum())
            first = len(key) - -(-3 * len(key) // 4) + 1
            if alone >= first:
                continue  # its first shingles stand nowhere else
            key, at = key[hit], at[hit]
            chosen = key[np.lexsort((key, total[at]))[: first - alone]]
            keys.append(chosen)
            owners.append(np.full(len(chosen), int(number)))
        if not keys:
            return
        key, owner = np.concatenate(keys), np.concatenate(owners)
        yield from _stars(key, owner, buckets)

    packed = by_block(nodes.select("block", "shingles"), [], ask, "bucket int, blob binary")
    told = per_bucket(packed, answer, "block long, number long, n long, shingles binary")
    both = nodes.select("block", "number", "n", "shingles").unionAll(told)
    chosen = stored(by_block(both, [], choose, "bucket int, blob binary, a long, b long"), f"{folder}/prefixes")

    def across(_: int, blobs: list[bytes]) -> Iterator[pd.DataFrame]:
        key = np.concatenate([np.frombuffer(b, "<u8", len(b) // 16) for b in blobs])
        owner = np.concatenate([np.frombuffer(b, "<i8", len(b) // 16, len(b) // 2) for b in blobs])
        for part in _stars(key, owner, 0):
            yield part[["a", "b"]]

    inside = chosen.where("a IS NOT NULL").select("a", "b")
    return inside.unionAll(per_bucket(chosen.where("bucket IS NOT NULL"), across, "a long, b long"))


def _stars(key: np.ndarray, owner: np.ndarray, buckets: int) -> Iterator[pd.DataFrame]:
    """Edges of each owner of a key to the key's smallest one; with buckets, also (key, smallest) for other blocks."""
    order = np.lexsort((owner, key))
    key, owner = key[order], owner[order]
    first = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
    least = owner[first][np.cumsum(first) - 1]
    edges = np.unique(np.stack([owner, least], axis=1)[owner != least], axis=0)
    a, b = contracted(edges[:, 0], edges[:, 1])
    yield pd.DataFrame({"bucket": pd.array([None] * len(a), "Int32"), "blob": [None] * len(a), "a": pd.array(a, "Int64"), "b": pd.array(b, "Int64")})
    if buckets:
        key, owner = key[first], owner[first]
        out = [(b, key[at].tobytes() + owner[at].astype("<i8").tobytes()) for b, at in by_bucket(_bucket(key, buckets), buckets)]
        yield pd.DataFrame({"bucket": pd.array([b for b, _ in out], "Int32"), "blob": [x for _, x in out], "a": pd.array([None] * len(out), "Int64"), "b": pd.array([None] * len(out), "Int64")})


# ---- signature trees --------------------------------------------------------------------------------------------


class Joined:
    """Which sets are in one group so far; ``links`` has the pairs that made it so."""

    def __init__(self, labels: list[int]):
        first: dict[int, int] = {}
        self.parent = [first.setdefault(x, i) for i, x in enumerate(labels)]
        self.links: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def link(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.links.append((i, j))


class Tree:
    """Nodes from the leaves up; node v's children are ``below[v]``, a leaf's is its set."""

    def __init__(self, sets: list[np.ndarray], members: list[int], joined: Joined):
        self.sets, self.joined = sets, joined
        # Similar sets often have the same smallest shingle, so they come to stand side by side.
        leaves = sorted(members, key=lambda i: (int(sets[i][0]), len(sets[i]), i))
        self.bits: list[int] = []
        self.low: list[int] = []
        self.high: list[int] = []
        self.crowded: list[int] = []  # most shingles beyond one a bit
        self.below: list[list[int]] = []
        self.leaf: list[int] = []  # the set of a leaf, else the first below it
        self.one: list[bool] = []  # all sets below are joined
        self.inner: list[bool] = []
        for i in leaves:
            places = np.zeros(SIGNATURE_BITS, bool)
            places[sets[i] % np.uint64(SIGNATURE_BITS)] = True
            self._add(int.from_bytes(np.packbits(places).tobytes()), len(sets[i]), len(sets[i]), len(sets[i]) - int(places.sum()), [], i, True)
        level = list(range(len(leaves)))
        while len(level) > 1:
            up = []
            for at in range(0, len(level), FANOUT):
                kids = level[at : at + FANOUT]
                bits = 0
                for k in kids:
                    bits |= self.bits[k]
                up.append(self._add(bits, min(self.low[k] for k in kids), max(self.high[k] for k in kids), max(self.crowded[k] for k in kids), kids, self.leaf[kids[0]], False))
            level = up
        self.top = level[0]

    def _add(self, bits: int, low: int, high: int, crowded: int, below: list[int], leaf: int, one: bool) -> int:
        for column, value in zip((self.bits, self.low, self.high, self.crowded, self.below, self.leaf, self.one, self.inner), (bits, low, high, crowded, below, leaf, one, bool(below))):
            column.append(value)
        return len(self.bits) - 1

    def group(self, v: int) -> int:
        """The group of all sets below, or -1 if there are several."""
        if not self.one[v]:
            found = {self.group(k) for k in self.below[v]}
            if len(found) > 1 or -1 in found:
                return -1
            self.one[v] = True
        return self.joined.root(self.leaf[v])

    def inside(self, v: int) -> None:
        """Links among the sets below v."""
        kids = self.below[v]
        for k in kids:
            self.inside(k)
        for i, a in enumerate(kids):
            for b in kids[i + 1 :]:
                self.across(a, self, b)

    def across(self, a: int, other: Tree, b: int) -> None:
        """Links between the sets below a here and those below b there."""
        mine = self.group(a)
        if mine >= 0 and mine == other.group(b):
            return
        if 4 * self.high[a] < 3 * other.low[b] or 4 * other.high[b] < 3 * self.low[a]:
            return
        common = (self.bits[a] & other.bits[b]).bit_count()
        most = min(self.high[a], other.high[b], common + self.crowded[a], common + other.crowded[b])
        if not near(most, self.low[a], other.low[b]):
            return
        if not self.inner[a] and not other.inner[b]:
            x, y = self.sets[self.leaf[a]], other.sets[other.leaf[b]]
            if near(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)):
                self.joined.link(self.leaf[a], other.leaf[b])
        elif not self.inner[a] or other.inner[b] and other.high[b] - other.low[b] > self.high[a] - self.low[a]:
            for k in other.below[b]:
                self.across(a, other, k)
        else:
            for k in self.below[a]:
                self.across(k, other, b)


def tree_links(sets: list[np.ndarray], sides: list[int], labels: list[int]) -> list[tuple[int, int]]:
    """Pairs that join all sets which link: among side 0 if there is no side 1, else between the sides. Equal labels are joined already."""
    joined = Joined(labels)
    left = Tree(sets, [i for i, s in enumerate(sides) if s == 0], joined) if 0 in sides else None
    if 1 not in sides:
        left.inside(left.top)
    elif left:
        right = Tree(sets, [i for i, s in enumerate(sides) if s == 1], joined)
        left.across(left.top, right, right.top)
    return joined.links


def linked(rows: DataFrame) -> DataFrame:
    """(a, b) of rows (task columns t0, t1, t2; side, label, number, shingles), a tree join for each task."""
    task = ["t0", "t1", "t2"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, []
        for part in parts:
            for row in zip(*(part[c].tolist() for c in task), part["side"].tolist(), part["label"].tolist(), part["number"].tolist(), part["shingles"]):
                if at != row[:3]:
                    if len(held) > 1:
                        yield _links(held)
                    at, held = row[:3], []
                held.append(row[3:])
        if len(held) > 1:
            yield _links(held)
        held = []
        give_back()

    return rows.select(*task, "side", "label", "number", "shingles").repartition(*task).sortWithinPartitions(*task, "side", "number").mapInPandas(run, "a long, b long")


def _links(held: list[tuple]) -> pd.DataFrame:
    sides, labels, numbers, raw = zip(*held)
    found = tree_links([np.frombuffer(r, "<u8") for r in raw], list(sides), list(labels))
    ends, number = np.array(found, np.int64).reshape(-1, 2), np.array(numbers, np.int64)
    a, b = contracted(number[ends[:, 0]], number[ends[:, 1]])
    return pd.DataFrame({"a": a, "b": b})


def labelled(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Adds ``label``: the component, or the number itself."""
    return rows.join(groups.select(F.col("node").alias("number"), F.col("component").alias("label")), "number", "left").withColumn("label", F.coalesce("label", "number"))


def links(nodes: DataFrame, folder: str) -> DataFrame:
    """(a, b): pairs of nodes of one group, enough of them to join every group."""
    candidates = stored(components(prefixes(nodes, folder), f"{folder}/candidates"), f"{folder}/candidates-found")
    amounts = stored(candidates.groupBy("component").agg(F.ceil(F.count("*") / BLOCK_SETS).alias("blocks")), f"{folder}/candidates-sizes")
    placed = candidates.join(amounts, "component").withColumnRenamed("node", "number")
    placed = stored(placed.withColumn("part", F.pmod(F.xxhash64("number"), "blocks")), f"{folder}/placed")
    content = nodes.select("number", "shingles")
    task = [F.col("component").alias("t0"), F.col("part").alias("t1"), F.lit(0).cast("long").alias("t2")]
    own = placed.join(content, "number").select(*task, F.lit(0).alias("side"), F.col("number").alias("label"), "number", "shingles")
    found = stored(linked(own), f"{folder}/links")
    wide = placed.where("blocks > 1")
    if wide.isEmpty():
        return found
    # Several blocks: the largest group of each block first, by one of its sets.
    state = stored(labelled(wide, components(found, f"{folder}/in-blocks")), f"{folder}/in-blocks-labels")
    largest = state.groupBy("component", "part", "label").agg(F.count("*").alias("n")).groupBy("component", "part").agg(F.max_by("label", F.struct("n", "label")).alias("number"))
    chosen = largest.join(content, "number").select(F.col("component").alias("t0"), F.lit(0).cast("long").alias("t1"), F.lit(0).cast("long").alias("t2"), F.lit(0).alias("side"), F.col("number").alias("label"), "number", "shingles")
    found = found.unionAll(stored(linked(chosen), f"{folder}/links-largest"))
    state = stored(labelled(wide, components(found, f"{folder}/across-blocks")), f"{folder}/across-blocks-labels")
    # Then what is outside a component's largest group with all blocks.
    top = state.groupBy("component", "label").agg(F.count("*").alias("n")).groupBy("component").agg(F.max_by("label", F.struct("n", "label")).alias("top"))
    top = stored(top, f"{folder}/largest")
    outside = state.join(top, "component").where("label <> top").drop("top")
    rooms = outside.groupBy("component").agg(F.ceil(F.count("*") / BLOCK_SETS).alias("rooms"))
    rooms = stored(rooms, f"{folder}/rooms")
    if rooms.isEmpty():
        return found
    outside = outside.join(rooms, "component").withColumn("room", F.pmod(F.xxhash64("number", F.lit(1)), "rooms"))
    everyone = state.join(rooms, "component")
    left = outside.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn("side", F.lit(0))
    right = everyone.withColumn("room", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rooms") - 1))).withColumn("side", F.lit(1))
    columns = [F.col("component").alias("t0"), F.col("room").alias("t1"), F.col("part").alias("t2"), "side", "label", "number"]
    pairs = left.select(*columns).unionAll(right.select(*columns)).join(content, "number")
    return found.unionAll(stored(linked(pairs), f"{folder}/links-outside"))


# ---- documents ---------------------------------------------------------------------------------------------------


def groups(spark: SparkSession, docs: DataFrame, folder: str, words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: size of its set, smallest doc_id reachable by links."""
    chosen = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("text").cast("string"))
    counted = sizes(chosen, folder, words)
    may_link = "times > 1 OR (n > 0 AND 4 * shared >= 3 * n)"
    own = F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id")
    alone = counted.where(f"NOT ({may_link})").select(own, F.col("n").alias("n_shingles"), own.alias("component_id"))
    sets = stored(sets_of(chosen.join(few(counted.where(may_link).select("doc_id")), "doc_id", "left_semi"), words), f"{folder}/sets")
    nodes = distinct_sets(sets, folder)
    found = components(links(nodes, folder), f"{folder}/groups")
    state = stored(labelled(nodes.select("number", "node", "rep"), found), f"{folder}/node-groups")
    least = stored(state.groupBy("label").agg(F.min("rep").alias("component_id")), f"{folder}/group-ids")
    named = stored(state.join(least, "label").select("node", "component_id"), f"{folder}/node-ids")
    rest = sets.select("doc_id", "n", "node").join(named, "node", "left")
    return alone.unionAll(rest.select(own, F.col("n").alias("n_shingles"), F.coalesce("component_id", own).alias("component_id")))


def one_of_each(spark: SparkSession, docs: DataFrame, folder: str, words: int = WORDS) -> DataFrame:
    """The rows of ``docs`` without all but the smallest doc_id of each group. A doc_id stays if one of its rows is its group's
    smallest; equal rows of one id become one. Rows without doc_id count as rows of one id.
    """
    found = stored(groups(spark, docs, folder, words), f"{folder}/found")
    stays = F.coalesce(F.col("component_id") == F.col("doc_id"), F.col("component_id").isNull())
    by_id = stored(found.groupBy("doc_id").agg(F.max(stays).alias("stays"), F.count("*").alias("times")), f"{folder}/decided")
    other = unused(docs, "decided_id")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(other))
    gone = by_id.where("NOT stays").select(F.col("doc_id").alias(other))
    kept = docs.join(few(gone), same, "left_anti")
    repeated = by_id.where("stays AND times > 1").select(F.col("doc_id").alias(other))
    if repeated.isEmpty():
        return kept
    return kept.join(few(repeated), same, "left_anti").unionAll(kept.join(few(repeated), same, "left_semi").dropDuplicates(["doc_id", "text"]))
