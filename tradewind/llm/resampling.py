"""Importance resampling: documents drawn by how much likelier their n-grams are in a target corpus than in their own.

Words are runs of ASCII letters (A-Z lower-cased), digits and characters beyond ASCII. Everything between them collapses to
one space, and an overlapped regex scan (``finditer(overlapped=True)``, look-behind at the boundary) emits at each word the spans of
the runs of one, two and three words that begin there. Each span's bytes go into a CRC, carried on from span to span; a
feature is its CRC modulo the number of buckets. The scan happens once: the features, two bytes each, are written to the shared folder,
from which tasks first sum a count per bucket (one row a bucket and task is shuffled) and then, with the gains known, each document's
weight. Adding Gumbel noise made from a hash of the id to the weight and taking the highest draws without replacement.

The ranking is distributed: rows are sorted by range, each partition counts its rows, and a row's rank is its place behind all
partitions before. To the driver and all tasks go one gain a bucket and one count a partition.

Null or empty texts, and texts without words: no features, weight 0. Very long texts are scanned whole; blocks are bounded by characters, or
hold one text. Null doc_ids: hashed as empty text, after all others in ties. Repeated rows count and are ranked each. Ties go to the smaller doc_id,
then by n_features and weight. No documents: no rows; no target texts: each target count is 0. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.llm.shared import give_back, stored
from tradewind.llm.words import blocks

BLOCK_CHARS = 4_000_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPANS = regex.compile(rb"(?<= )([^ ]+)(?:( [^ ]+)( [^ ]+)?)?")  # a word, the next with its space, and the one after that
SCANNED = "n_words long, features binary"


def even(texts: pa.Array) -> pa.Array:
    """Lower-cased words, a space before each."""
    return pc.replace_substring_regex(pc.binary_join_element_wise(" ", pc.ascii_lower(texts), ""), SEPARATORS, " ")


def crcs(text: bytes) -> tuple[int, array]:
    """Words of an even text and the CRC of every run of one to three of them."""
    crc32, out, words = zlib.crc32, array("I"), 0
    for span in SPANS.finditer(text, overlapped=True):
        one, two, three = span.groups()
        words += 1
        crc = crc32(one)
        out.append(crc)
        if two:
            crc = crc32(two, crc)
            out.append(crc)
            if three:
                out.append(crc32(three, crc))
    return words, out


def scanned(texts: DataFrame, keep: list[str], buckets: int) -> DataFrame:
    """Columns ``keep``, and the words and features of (text); a feature's bucket is an unsigned 16-bit integer."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("between 1 and 65,536 buckets")
    kept = texts.select(*keep, "text")
    schema = ", ".join([*(f"{c} {kept.schema[c].dataType.simpleString()}" for c in keep), SCANNED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, some in blocks(batch.column("text"), BLOCK_CHARS):
                words, features = [], []
                for row in even(some).cast(pa.binary()):
                    n, found = crcs(row.as_py())
                    words.append(n)
                    features.append((np.frombuffer(found, np.uint32) % buckets).astype("<u2").tobytes())
                columns = [batch.column(c).slice(at, len(some)) for c in keep]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(words, pa.int64()), pa.array(features, pa.binary())], [*keep, "n_words", "features"])

    return kept.mapInArrow(run, schema)


def bucket_counts(features: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n): features of all rows in each bucket that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for row in batch.column("features"):
                counts += np.bincount(np.frombuffer(row.as_py(), "<u2"), minlength=buckets)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(counts[held])], ["bucket", "n"])

    return features.select("features").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(spark: SparkSession, source: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """floor(1000 * ln) of the target's share of a bucket against the source's, one added to each count."""
    both = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(source.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
    both = both.select("bucket", *(F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("s", "t"))).toPandas().sort_values("bucket")
    s, t = both["s"].to_numpy(), both["t"].to_numpy()
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weighed(features: DataFrame, gain: np.ndarray, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and n_words, n_features and the sum of gains."""
    schema = ", ".join([*(f"{c} {features.schema[c].dataType.simpleString()}" for c in keep), "n_words long, n_features long, weight long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("features")
            sizes = pc.binary_length(raw).to_numpy(zero_copy_only=False).astype(np.int64) // 2
            weights = np.fromiter((gain[np.frombuffer(r.as_py(), "<u2")].sum() for r in raw), np.int64, len(raw))
            columns = [batch.column(c) for c in (*keep, "n_words")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes), pa.array(weights)], [*keep, "n_words", "n_features", "weight"])
        give_back()

    return features.select(*keep, "n_words", "features").mapInArrow(run, schema)


def noise(doc_id: Column, seed: str) -> Column:
    """floor(1000 * Gumbel) of 32 bits of sha256(``seed:doc_id``)."""
    salted = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    bits = F.conv(F.substring(F.sha2(salted.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((bits + F.lit(0.5)) / F.lit(4294967296.0))))


def ranked(rows: DataFrame, order: list[Column], chosen: Column, percent: int, folder: str) -> DataFrame:
    """``rank`` of the highest ``percent`` in 100 (rounded down) of the rows ``chosen`` holds for, in ``order``; null for all others."""
    n = max(1, rows.rdd.getNumPartitions())
    dealt = rows.withColumn("chosen", chosen).repartitionByRange(n, F.desc("chosen"), *order).sortWithinPartitions(F.desc("chosen"), *order)
    # The number of a row in its partition, written with it: later readers see one and the same order.
    placed = stored(dealt.withColumn("place", F.monotonically_increasing_id()), f"{folder}/placed")
    part = F.shiftright("place", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.count_if("chosen").alias("eligible")).collect()  # a row per partition
    before, total, draws = {}, 0, sum(r["eligible"] for r in sizes) * percent // 100
    for r in sorted(sizes, key=lambda r: r["part"]):
        before[r["part"]], total = total, total + r["n"]
    starts = rows.sparkSession.createDataFrame(sorted(before.items()), "part long, before long")
    rank = F.col("before") + placed["place"].bitwiseAND((1 << 33) - 1) + 1
    return placed.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("rank", F.when(rank <= draws, rank)).drop("part", "before", "place", "chosen")


def draw(spark: SparkSession, docs: DataFrame, target: DataFrame, folder: str, buckets: int = 10_000, least_words: int = 20, percent: int = 5, seed: str = "42") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs``; ranks 1, 2, 3... of those drawn towards ``target``."""
    features = stored(scanned(docs, ["doc_id"], buckets), f"{folder}/features")
    towards = stored(scanned(target, [], buckets), f"{folder}/target")
    gain = gains(spark, bucket_counts(features, buckets), bucket_counts(towards, buckets), buckets)
    scored = weighed(features, gain, ["doc_id"]).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = stored(scored, f"{folder}/scored")
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight")]
    found = ranked(scored, order, F.col("n_words") >= least_words, percent, folder)
    return found.select(F.col("doc_id").cast("long"), "n_features", "weight", F.col("score").cast("long"), F.col("rank").cast("long"))
