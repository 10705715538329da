"""Small tables with the awkward rows, and brute-force versions."""

from __future__ import annotations

import random
import re

from pyspark.sql import DataFrame, SparkSession

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# Columns that operators use inside, as extra columns of a table.
CLASHING = [
    "bucket", "blob", "block", "number", "label", "node", "score", "part", "n", "start", "end", "sequence_id", "component", "rank",
    "gone", "repeated", "decided_id", "stays", "times", "secret_spans", "secret_assign", "secret_base", "spans_base", "spans_assign", "spans_random",
    "quality", "features", "n_words", "weight", "chosen", "place", "before", "piece", "length", "offset", "ids", "found", "predicted", "held_out",
]


def words(rng: random.Random, n: int, pool: int = 400) -> str:
    return " ".join(f"{rng.choice(['the', 'of', 'and'])}{rng.randrange(pool)}" if rng.random() < 0.7 else rng.choice(["a", "in", "to"]) for _ in range(n))


def texts() -> list[tuple[int | None, str | None]]:
    """Nulls, empty and blank texts, repeated rows, copies, near copies, shared passages, a very long text."""
    rng = random.Random(4)
    rows: list[tuple[int | None, str | None]] = [(i, words(rng, rng.randrange(20, 200))) for i in range(40)]
    base, passage = rows[3][1], words(rng, 60)
    rows += [(40 + i, base) for i in range(6)]
    for i in range(8):
        w = base.split(" ")
        w[rng.randrange(len(w))] = f"changed{i}"
        rows.append((50 + i, " ".join(w)))
    rows += [(60 + i, f"{words(rng, 30)}\n{passage}\n{words(rng, 10)}") for i in range(6)]
    rows += [(70, None), (71, ""), (72, " \t\n "), (73, "one two"), (74, "one two"), (75, "one"), (None, base), (None, None), (None, "x y z")]
    rows += [(76, rows[5][1]), (76, rows[5][1]), (77, words(rng, 50)), (77, words(rng, 50))]
    rows += [(80, words(rng, 20_000)), (81, "abc " * 3_000), (82, "é ü 中文 𝄞 " * 20), (83, "ab" * 200), (84, "It's  two\t\ttabs\r\n and 's  end ")]
    return rows


def documents(spark: SparkSession, rows: list[tuple[int | None, str | None]], extra: bool = False) -> DataFrame:
    docs = spark.createDataFrame([(i, t, "en", "s", len(t) if t else None) for i, t in rows], DOCS)
    if extra:
        for c in CLASHING:
            docs = docs.selectExpr("*", f"cast(1 as string) AS `{c}`")
    return docs.repartition(3)


def lower_words(text: str | None) -> list[str]:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def by(rows, *names: str) -> list[tuple]:
    """Rows as sorted tuples, nulls first."""
    return sorted((tuple(r[n] for n in names) for r in rows), key=lambda r: [(x is not None, x if x is not None else 0) for x in r])
