"""Jobs that keep stored rollups fresh, and the maintenance jobs.

An outside scheduler calls the refresh jobs, which write the refresh pointer. Jobs on the intake's tables (``purge``, ``apply_retention``,
``mark_read``, ``compact``) are given to ``intake.start(between=...)``, which runs them between batches, as its pointer has one writer.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clock import add_months, day_of, month_column, month_of
from ..operators import maintenance, notifications, upserts
from ..operators.rollups import ROLLUPS, Rollup, difference, finished, merged, states
from ..schemas import RETENTION_MONTHS, TABLES, conform
from ..sources.tables import Tables
from ..sources.warehouse import INPUTS, USERS_FOLDED, Transaction, Warehouse
from ..streaming.intake import utc_now


def _log(warehouse: Warehouse, **row: object) -> None:
    spec = TABLES["mv_refresh_log"]
    values = tuple(row.get(c) for c in spec.columns)
    tx = warehouse.begin()
    # A refresh has two rows: one at its start, one at its end. The start row is replaced by folding.
    tx.append(spec.name, warehouse.spark.createDataFrame([values], spec.schema))
    tx.commit()


def refresh_log(warehouse: Warehouse) -> DataFrame:
    """One row per refresh."""
    return warehouse.read("mv_refresh_log")


def refresh(
    warehouse: Warehouse,
    name: str,
    facts: Tables | None = None,
    clock: Callable[[], datetime] = utc_now,
    build: Callable[[DataFrame], DataFrame] | None = None,
) -> str:
    """Recompute one rollup and switch to it; 'SUCCESS' or 'FAILED', with a log row either way.

    When the facts are in the same warehouse, only the folders that came or went since the last refresh are read; their
    states are added to the stored one, or taken out of it. Readers see the old or the new rollup.
    """
    spec = ROLLUPS[name]
    started = clock()
    _log(warehouse, mv_name=name, refresh_started_at=started, status="RUNNING")
    try:
        tx = warehouse.begin()
        if facts is None and build is None:
            _refresh_by_states(warehouse, tx, spec)
        else:
            source = warehouse if facts is None else facts
            tx.replace(name, (build or spec.build)(source.read(spec.fact) if build else source.facts_of(name)))
            _forget_state(tx, spec)
        tx.commit()
        rows = warehouse.read(name).count()
    except Exception as error:  # the failure is the result: it goes to the log for the operators
        _log(
            warehouse,
            mv_name=name,
            refresh_started_at=started,
            refresh_completed_at=clock(),
            status="FAILED",
            error_message=str(error),
        )
        return "FAILED"
    _log(
        warehouse,
        mv_name=name,
        refresh_started_at=started,
        refresh_completed_at=clock(),
        status="SUCCESS",
        rows_affected=rows,
    )
    return "SUCCESS"


def _forget_state(tx: Transaction, spec: Rollup) -> None:
    """The rollup was made another way: the next refresh starts anew."""
    tx.use(spec.state, {})
    tx.mark(f"{INPUTS}{spec.name}", {})


def _refresh_by_states(warehouse: Warehouse, tx: Transaction, spec: Rollup) -> None:
    """Add what came and take out what went, folder by folder; of the rollup only the days met change.

    Folders that went are read once more, as ``vacuum`` leaves them for a time; if they are gone, or there is no state, all starts anew.
    """
    mark = f"{INPUTS}{spec.name}"
    now = tx.state.tables.get(spec.fact, {})
    came, went = warehouse.changed_folders(spec, tx.state)
    # Whole months that went (retention) need no arithmetic.
    left = [m for m in tx.state.marks.get(mark, {}) if m not in now]
    if not came and not went and not left:
        return
    tx.drop_months(spec.name, left)
    tx.drop_months(spec.state, left)
    if not tx.state.marks.get(mark) or not tx.state.folders(spec.state) or not warehouse.present(went):
        _forget_state(tx, spec)
        tx.use(spec.name, {})
        came, went = [f for fs in now.values() for f in fs], []
    tx.mark(mark, now)
    parts = [states(warehouse.folders_as_table(spec.fact, folders), spec, sign) for folders, sign in ((came, 1), (went, -1)) if folders]
    if not parts:
        return
    delta = parts[0] if len(parts) == 1 else merged(parts[0].unionAll(parts[1]))
    before = tx.months(spec.state)
    tx.append(spec.state, delta)
    written = {m: [f for f in fs if f not in before.get(m, [])] for m, fs in tx.months(spec.state).items()}
    months = [m for m, fs in written.items() if fs]
    if not any(before.get(m) for m in months):
        # Nothing to add to: the state written has each combination once, and no day of the rollup is kept.
        whole = warehouse.folders_as_table(spec.state, [f for m in months for f in written[m]])
        tx.replace(spec.name, finished(whole, spec), months)
        return
    days = warehouse.folders_as_table(spec.state, [f for m in months for f in written[m]]).select("day").distinct()
    whole = warehouse.folders_as_table(spec.state, [f for m in months for f in tx.months(spec.state)[m]])
    fresh = finished(merged(whole.join(days, "day", "left_semi")), spec)
    old = warehouse.folders_as_table(spec.name, [f for m in months for f in tx.months(spec.name).get(m, [])])
    tx.replace(spec.name, old.join(days, "day", "left_anti").unionByName(conform(fresh, spec.name)), months)


def refresh_all(
    warehouse: Warehouse, facts: Tables | None = None, clock: Callable[[], datetime] = utc_now
) -> dict[str, str]:
    """The four rollups one after the other; one failing does not stop the rest."""
    return {name: refresh(warehouse, name, facts, clock) for name in ROLLUPS}


def refresh_by_difference(warehouse: Warehouse, name: str, facts: Tables) -> DataFrame:
    """Recompute, find the rows that differ, and switch only the months they are in.

    Returns the differing rows (keys, new values, change).
    """
    spec = ROLLUPS[name]
    tx = warehouse.begin()
    before = tx.months(name)
    # The new rollup is computed once, by writing it; the comparison reads what was written.
    written = {m: [f] for m, f in tx.write(name, spec.build(facts.facts_of(name))).items()}
    old = warehouse.folders_as_table(name, tx.state.folders(name))
    new = warehouse.folders_as_table(name, [f for fs in written.values() for f in fs])
    changes = difference(old, new, spec.keys)
    month = month_column(TABLES[name].time).alias("month")
    # One value per changed month: bounded by the calendar.
    changed = {r.month for r in changes.select(month).distinct().collect()}
    if changed:
        kept = {m: f for m, f in before.items() if m not in changed}
        tx.use(name, kept | {m: f for m, f in written.items() if m in changed})
        _forget_state(tx, spec)
        tx.commit()
    return changes


def compare_with_direct(tables: Tables, after: datetime) -> DataFrame:
    """The trade rollup beside a direct aggregation of the facts, day by day, and whether they agree.

    The first day can differ: the rollup is cut at whole days, the facts at ``after`` itself.
    """
    stored = tables.rollup("mv_trades_daily", after=after).select("day", "trade_count", "revenue")
    direct = (
        tables.read("fact_trade", after=after)
        .groupBy(day_of("executed_at").alias("day"))
        .agg(F.count(F.lit(1)).alias("trade_count"), F.sum("amount").alias("revenue"))
    )
    s, d = stored.alias("s"), direct.alias("d")
    same = F.col("s.trade_count").eqNullSafe(F.col("d.trade_count")) & F.col("s.revenue").eqNullSafe(
        F.col("d.revenue")
    )
    return s.join(d, F.col("s.day") == F.col("d.day"), "full_outer").select(
        F.coalesce("s.day", "d.day").alias("day"),
        F.col("s.trade_count").alias("rollup_trade_count"),
        F.col("d.trade_count").alias("direct_trade_count"),
        F.col("s.revenue").alias("rollup_revenue"),
        F.col("d.revenue").alias("direct_revenue"),
        same.alias("agrees"),
    )


# -- maintenance jobs


def purge(warehouse: Warehouse, as_of: datetime, refresh_days: int = 30) -> None:
    """Drop old refresh-log rows and expired notifications; only folders holding such rows are rewritten."""
    gone = {
        "mv_refresh_log": maintenance.old_refresh(as_of, refresh_days),
        "system_notifications": maintenance.expired(as_of),
    }
    for table, drop in gone.items():  # of different pointers
        tx = warehouse.begin()
        folders = warehouse.folders_holding(
            table, tx.state.folders(table), lambda rows, drop=drop: rows.filter(drop)
        )
        if folders:
            tx.replace_folders(table, folders, warehouse.folders_as_table(table, folders).filter(~drop))
            tx.commit()


def apply_retention(warehouse: Warehouse, as_of: datetime) -> dict[str, list[str]]:
    """Drop the month folders past retention: no data is read."""
    tx = warehouse.begin()
    dropped = {}
    for fact, keep in RETENTION_MONTHS.items():
        oldest = month_of(add_months(as_of, -keep))
        dropped[fact] = [m for m in tx.state.tables.get(fact, {}) if m < oldest]
        tx.drop_months(fact, dropped[fact])
    tx.commit()
    return dropped


def mark_read(warehouse: Warehouse, reads: DataFrame) -> None:
    """Keep read receipts as rows of their own, merged when notifications are read; no notification is rewritten.

    A user's receipt for all becomes one for each row the user has not read; only for such receipts are notifications read.
    """
    tx = warehouse.begin()
    unread = warehouse.read("system_notifications").filter(~F.col("read_status"))
    everything = reads.filter(F.col("notification_id").isNull())
    if everything.isEmpty():
        unread = unread.limit(0)
    tx.append("notification_reads", notifications.receipts(unread, reads))
    tx.commit()


def fold_reads(warehouse: Warehouse) -> None:
    """Write receipts into the notifications they mark, in the folders that hold such rows, and drop them."""
    table = "system_notifications"
    tx = warehouse.begin()
    receipts = warehouse.folders_as_table("notification_reads", tx.state.folders("notification_reads"))
    ids = receipts.select("notification_id").distinct()
    folders = warehouse.folders_holding(
        table, tx.state.folders(table), lambda rows: rows.filter(~F.col("read_status")).join(ids, "notification_id", "left_semi")
    )
    if folders:
        rows = warehouse.folders_as_table(table, folders)
        tx.replace_folders(table, folders, notifications.with_receipts(rows, receipts))
    tx.use("notification_reads", {})
    tx.commit()


def fold_users(warehouse: Warehouse) -> None:
    """Put the changes of each user together, in one folder that has each user once."""
    tx = warehouse.begin()
    stored = upserts.as_changes(warehouse.folders_as_table("dim_users", tx.state.folders("dim_users")))
    changes = warehouse.folders_as_table("dim_user_changes", tx.state.folders("dim_user_changes"))
    tx.replace("dim_user_changes", upserts.fold_changes(stored.unionByName(changes)))
    tx.use("dim_users", {})
    (folder,) = tx.state.folders("dim_user_changes")
    tx.mark(USERS_FOLDED, folder)
    tx.commit()


def compact(warehouse: Warehouse, least: int = 24) -> None:
    """Merge the folders that micro-batches leave behind, in months that have many of them."""
    states_of = {r.state for r in ROLLUPS.values()}
    folds = {"dim_user_changes": fold_users, "notification_reads": fold_reads}
    for table in TABLES:
        tx = warehouse.begin()
        if table in folds:
            if len(tx.state.folders(table)) >= least:
                folds[table](warehouse)
            continue
        tx.compact(table, least, merged if table in states_of else None)
        if tx.state != tx.base:
            tx.commit()
