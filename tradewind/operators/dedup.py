"""Exactly-once by event id: within a batch, against the ledger, or by a stream's own state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, key: str, order: Column) -> DataFrame:
    """One row per key, the first by ``order``.

    An aggregate, not a window: copies are dropped on the map side, so a key that holds a third of all
    rows reaches the reducer as one row per task.
    """
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def first_digests(rows: DataFrame, key: str, order: Sequence[str], text: str) -> DataFrame:
    """One row per key, the first by ``order`` and then by a digest of a long text, which is not sent; ``split`` where first rows differ in their text."""
    rest = [c for c in rows.columns if c not in (key, *order, text)]
    short = rows.select(key, *order, F.xxhash64(text).alias("digest"), *rest)
    least, most = F.struct(*order, "digest", *rest), F.struct(*order, F.bitwise_not("digest").alias("digest"))
    found = short.groupBy(key).agg(F.min(least).alias("r"), F.min(most).alias("s"))
    split = (F.col("r.digest") != F.bitwise_not("s.digest")).alias("split")
    return found.select(key, *(F.col(f"r.{c}").alias(c) for c in (*order, *rest)), split)


def first_by_text(rows: DataFrame, key: str, order: Sequence[str], text: str, folder: str) -> DataFrame:
    """One row per key, the first by ``order`` and then by a long text, which the result does not have.

    Texts are not sent: rows are compared by the rest and carry a digest that tells whether the first rows of a key have one text. Only the texts of keys where they
    have not are compared. ``folder`` takes the rows found, so that those keys are known, and counted, before any text is asked for.
    """
    first_digests(rows, key, order, text).write.option("compression", "zstd").parquet(folder)
    stored = rows.sparkSession.read.parquet(folder)
    whole, open_keys = stored.filter(~F.col("split")).drop("split"), stored.filter("split").select(key)
    if open_keys.isEmpty():
        return whole
    compared = first_per_key(rows.join(open_keys, key, "left_semi"), key, F.struct(*order, text))
    return whole.unionByName(compared.select(whole.columns))


def unseen(df: DataFrame, ledger: DataFrame, key: str = "event_id") -> DataFrame:
    """Rows whose key is not in the ledger; ``df`` must hold each key once.

    The ledger only ever grows, so it is the streamed side: it is first cut to the keys of this batch
    (Spark broadcasts those when their size allows, and the ledger is not shuffled), and only
    the keys found are taken out of the batch.
    """
    seen = ledger.select(key).join(df.select(key), key, "left_semi")
    return df.join(seen, key, "left_anti")


def new_rows(df: DataFrame, existing: DataFrame, key: str, order: Column) -> DataFrame:
    """Insert-if-absent: first row per key, unless ``existing`` has it."""
    return unseen(first_per_key(df, key, order), existing, key)


def once(stream: DataFrame, key: str = "event_id", time: str | None = None, delay: str | None = None) -> DataFrame:
    """Each key of a stream once: the query's own state knows the keys it has had, across batches and restarts.

    The state (RocksDB, beside the checkpoint; see ``session.prepare``) is split by key and holds the keys alone, so a batch costs what it
    brings, however many came before. With ``delay``, copies arrive within that time of each other and older keys are forgotten.
    """
    if delay is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
