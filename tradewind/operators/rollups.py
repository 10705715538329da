"""The four daily rollups as mergeable states, and the row-level difference between two versions of one.

A state has a row for each day and sum (how many values, their total), and one for each day and distinct value (how many rows have it).
States add up: those of two sets of rows, merged, are the state of both, and a state taken with sign -1 takes rows out again. So a rollup
follows late, replaced and deleted rows from these rows alone. Distinct values are kept as rows with counts, not as bitmaps, as a bit
cannot be taken back and scattered ids would cost a whole bitmap each.

Plans: one aggregation for the sums and one for each distinct column, each over the columns it needs, combined on the map side. The distinct
ones shuffle by (day, value), so a day holding a third of all rows is spread over every reducer; what is shuffled by day alone is
a partial row per task and day. Each aggregation reads the facts anew, so facts that are joins are put together once before (``Kept``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import day_of

ROWS = "rows"
AVERAGE = "decimal(22,10)"
TOTAL = "decimal(28,6)"


@dataclass(frozen=True)
class Rollup:
    """What a rollup counts: result columns by the fact columns they come from."""

    name: str
    fact: str
    time: str
    count: str
    sums: dict[str, str] = field(default_factory=dict)
    averages: dict[str, str] = field(default_factory=dict)
    distincts: dict[str, str] = field(default_factory=dict)
    shares: dict[str, str] = field(default_factory=dict)  # kept in the state only: by this column, the sum of that
    keys: tuple[str, ...] = ("day",)
    where: Callable[[], Column] | None = None

    @property
    def state(self) -> str:
        """Name of the stored state."""
        return f"{self.name}_state"

    @property
    def total(self) -> str | None:
        """Result column of the last sum, the one in money or credits."""
        return list(self.sums)[-1] if self.sums else None

    def rows(self, facts: DataFrame) -> DataFrame:
        return facts if self.where is None else facts.filter(self.where())

    def groups(self) -> list[Column]:
        return [day_of(self.time).alias("day") if k == "day" else F.col(k) for k in self.keys]

    def build(self, facts: DataFrame) -> DataFrame:
        return finished(states(facts, replace(self, shares={})), self)

    @property
    def columns(self) -> list[str]:
        """What ``build`` takes from facts, when all of them count."""
        return sorted({self.time, *self.sums.values(), *self.averages.values(), *self.distincts.values()})

    def size(self, facts: DataFrame) -> DataFrame:
        """One row, ``n``: how many rows ``build`` gives; nothing is summed or told apart for it."""
        return self.rows(facts).select(*self.groups()).distinct().agg(F.count(F.lit(1)).alias("n"))


def states(facts: DataFrame, spec: Rollup, sign: int = 1) -> DataFrame:
    """(day, event_type, measure, value, n, total): each combination once. ``sign`` -1 takes the rows out of a state they are in."""
    rows = spec.rows(facts)
    group = F.col("event_type") if "event_type" in spec.keys else F.lit(None).cast("string")
    keys = [day_of(spec.time).alias("day"), group.alias("event_type")]
    summed = sorted({*spec.sums.values(), *spec.averages.values()})
    sums = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias(f"n_{ROWS}"), *(F.count(c).alias(f"n_{c}") for c in summed), *(F.sum(c).cast(TOTAL).alias(f"t_{c}") for c in summed)
    )

    def entry(measure: str, total: Column) -> Column:
        fields = {"measure": F.lit(measure), "value": F.lit(None).cast("string"), "n": F.col(f"n_{measure}") * sign, "total": (total * sign).cast(TOTAL)}
        return F.struct(*(c.alias(name) for name, c in fields.items()))

    entries = [entry(ROWS, F.lit(0)), *(entry(c, F.col(f"t_{c}")) for c in summed)]
    parts = [sums.select("day", "event_type", F.inline(F.array(*entries))).filter(F.col("n") != 0)]
    for c in spec.distincts.values():
        values = rows.filter(F.col(c).isNotNull()).groupBy(*keys, c).agg(F.count(F.lit(1)).alias("n"))
        parts.append(
            values.select("day", "event_type", F.lit(f"distinct {c}").alias("measure"), F.col(c).cast("string").alias("value"), F.col("n") * sign, F.lit(0).cast(TOTAL).alias("total")).toDF(*parts[0].columns)
        )
    parts += [shares(rows, spec, c, sign) for c in spec.shares]
    return reduce(DataFrame.unionAll, parts)


def shares(rows: DataFrame, spec: Rollup, column: str, sign: int = 1) -> DataFrame:
    """State rows of one column's values, with the sum that goes to each."""
    day, group = day_of(spec.time).alias("day"), F.lit(None).cast("string").alias("event_type")
    summed = rows.groupBy(day, group, F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"), F.sum(spec.shares[column]).alias("total"))
    return summed.select("day", "event_type", F.lit(f"by {column}").alias("measure"), "value", (F.col("n") * sign).alias("n"), (F.col("total") * sign).cast(TOTAL).alias("total"))


def shared(state: DataFrame, spec: Rollup, column: str) -> DataFrame:
    """(column, n, total) over all days of a state, however many parts it has."""
    both = state.filter(F.col("measure") == f"by {column}").groupBy(F.col("value").alias(column)).agg(F.sum("n").alias("n"), F.sum("total").cast(TOTAL).alias("total"))
    return both.filter(F.col("n") > 0)


def merged(parts: DataFrame) -> DataFrame:
    """States of several sets of rows as one; what is used up is left out. As many values may have come as went, with another total."""
    both = parts.groupBy("day", "event_type", "measure", "value").agg(F.sum("n").alias("n"), F.sum("total").cast(TOTAL).alias("total"))
    return both.filter((F.col("n") != 0) | (F.col("total") != 0))


def finished(state: DataFrame, spec: Rollup) -> DataFrame:
    """The rollup's rows from a state that has each combination once."""

    def of(measure: str, column: str) -> Column:
        return F.max(F.when(F.col("measure") == measure, F.col(column)))

    columns = {result: of(c, "total") for result, c in spec.sums.items()}
    columns[spec.count] = of(ROWS, "n")
    columns |= {result: (of(c, "total") / of(c, "n")).cast(AVERAGE) for result, c in spec.averages.items()}
    columns |= {result: F.count_if(F.col("measure") == f"distinct {c}") for result, c in spec.distincts.items()}
    rows = state.groupBy(*spec.keys).agg(*(c.alias(name) for name, c in columns.items()))
    return rows.filter(F.col(spec.count).isNotNull())


_ALL = (
    Rollup(
        "mv_trades_daily",
        fact="fact_trade",
        time="executed_at",
        count="trade_count",
        sums={"credits_sold": "quantity", "revenue": "amount"},
        averages={"avg_unit_price": "unit_price"},
        distincts={"unique_buyers": "buyer_id", "unique_sellers": "seller_id"},
        shares={"currency": "amount"},
    ),
    # Every lifecycle row counts, whatever its status.
    Rollup(
        "mv_issuance_daily",
        fact="fact_issuance",
        time="issued_at",
        count="issuance_count",
        sums={"credits_issued": "quantity_tco2e"},
        averages={"avg_issuance": "quantity_tco2e"},
        distincts={"unique_users": "user_id"},
    ),
    Rollup(
        "mv_payments_daily",
        fact="fact_payment",
        time="completed_at",
        count="payment_count",
        sums={"total_payments": "amount"},
        averages={"avg_payment": "amount"},
        distincts={"payment_methods_used": "payment_method"},
        where=lambda: F.col("status") == "COMPLETED",
    ),
    Rollup(
        "mv_user_activity_daily",
        fact="fact_user_activity",
        time="occurred_at",
        count="event_count",
        distincts={"unique_users": "user_id"},
        keys=("day", "event_type"),
    ),
)
ROLLUPS: dict[str, Rollup] = {r.name: r for r in _ALL}


def trades_daily(trades: DataFrame) -> DataFrame:
    return ROLLUPS["mv_trades_daily"].build(trades)


def latest_only(facts: DataFrame, entity: str, time: str) -> DataFrame:
    """Optional input filter: one row per order / issuance / payment, its newest lifecycle row."""
    rest = [c for c in facts.columns if c != entity]
    newest = facts.groupBy(entity).agg(
        F.max_by(F.struct(*rest), F.struct(time, *(c for c in rest if c != time))).alias("r")
    )
    return newest.select(entity, "r.*").select(*facts.columns)


def difference(old: DataFrame, new: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows to INSERT, UPDATE or DELETE so that ``old`` becomes ``new``; new values, keys from either side."""
    values = [c for c in new.columns if c not in keys]
    o, n = old.alias("o"), new.alias("n")
    same_key: Column = F.lit(True)
    for k in keys:
        same_key = same_key & F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
    in_old = o.withColumn("in_old", F.lit(True)).alias("o")
    in_new = n.withColumn("in_new", F.lit(True)).alias("n")
    unchanged: Column = F.lit(True)
    for v in values:
        unchanged = unchanged & F.col(f"o.{v}").eqNullSafe(F.col(f"n.{v}"))
    change = (
        F.when(F.col("in_old").isNull(), "INSERT")
        .when(F.col("in_new").isNull(), "DELETE")
        .when(~unchanged, "UPDATE")
    )
    return (
        in_old.join(in_new, same_key, "full_outer")
        .select(
            *(F.coalesce(f"n.{k}", f"o.{k}").alias(k) for k in keys),
            *(F.col(f"n.{v}").alias(v) for v in values),
            change.alias("change"),
        )
        .filter(F.col("change").isNotNull())
    )
