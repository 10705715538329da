"""The star schema as Parquet on any Hadoop file system, switched by two small pointer files.

Plain Parquet has neither MERGE nor a safe overwrite of what is being read. So data folders are never
changed: every write goes to a new folder, and a numbered JSON file names the folders that count,
per table and month. Readers take the newest file; a crash before the switch leaves the old state whole.

There are two pointers, each with one writer: the intake's (facts, users, logs, ledger, and how far the stream got) and
the refresh job's (rollups, what they were made from, the refresh log). A second writer of either fails on
commit; nothing is rebased or retried. Jobs on the intake's tables run between its batches.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.clock import month_column, month_of
from ..operators import maintenance, notifications, upserts
from ..operators.refreshes import folded
from ..operators.rollups import ROLLUPS, Rollup, shared, shares
from ..schemas import TABLES, conform
from .tables import Tables

UNDATED = "all"
POINTERS = "_commits"
INTAKE, REFRESH = "intake", "refresh"
INPUTS = "inputs of "  # begins the marks of the refresh job
REFRESH_TABLES = {*ROLLUPS, *(r.state for r in ROLLUPS.values()), "mv_refresh_log"}
USERS_FOLDED = "user changes folded into"  # mark: the folder that has each of its users once
# Facts whose rows were once written in a currency that is read as another since.
RESTATED = ("fact_trade", "fact_payment")

# A report may read a folder this long after it was replaced; vacuum refuses anything shorter than the least.
KEEP = timedelta(days=1)
LEAST_KEEP = timedelta(hours=1)


class ConflictError(RuntimeError):
    """Another writer committed first."""


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared folder the cluster names; removed when the driver ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by driver and executors")
        base = tempfile.mkdtemp(prefix="tradewind-")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    files = Files(spark)
    files.make(path)
    files.drop_at_exit(path)
    return path


class Files:
    """The few file-system calls needed, through Hadoop so that any store works."""

    def __init__(self, spark: SparkSession):
        self._jvm = spark._jvm
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self._conf)

    def make(self, path: str) -> None:
        self._fs(path).mkdirs(self._path(path))

    def names(self, path: str) -> list[str]:
        fs, p = self._fs(path), self._path(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def older(self, path: str, than: datetime) -> list[str]:
        """Names of what was last changed before a moment (UTC)."""
        fs, p = self._fs(path), self._path(path)
        limit = than.replace(tzinfo=UTC).timestamp() * 1000
        found = fs.listStatus(p) if fs.exists(p) else []
        return sorted(s.getPath().getName() for s in found if s.getModificationTime() < limit)

    def read(self, path: str) -> str:
        stream = self._fs(path).open(self._path(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put_new(self, path: str, text: str) -> None:
        """Write beside, then rename without overwrite: readers see all of it or nothing."""
        folder, name = path.rsplit("/", 1)
        beside = f"{folder}/.{name}.{uuid.uuid4().hex}"
        stream = self._fs(beside).create(self._path(beside), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        rename = self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
        none = self._jvm.java.lang.reflect.Array.newInstance(rename, 0)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            self._fs(path).getUri(), self._conf
        )
        try:
            context.rename(self._path(beside), self._path(path), none)
        except Exception as error:
            self.drop(beside)
            if "FileAlreadyExists" in str(error):
                raise ConflictError(path) from error
            raise

    def drop(self, path: str) -> None:
        self._fs(path).delete(self._path(path), True)

    def drop_at_exit(self, path: str) -> None:
        self._fs(path).deleteOnExit(self._path(path))


@dataclass
class State:
    """What both pointers say: table -> month -> folders, plus free-form marks (stream progress, rollup inputs)."""

    numbers: dict[str, int] = field(default_factory=dict)
    tables: dict[str, dict[str, list[str]]] = field(default_factory=dict)
    marks: dict[str, object] = field(default_factory=dict)

    @property
    def number(self) -> int:
        """Commits so far."""
        return sum(self.numbers.values())

    def copy(self) -> State:
        return State(**json.loads(json.dumps(vars(self))))

    def folders(self, table: str, first_month: str | None = None) -> list[str]:
        months = self.tables.get(table, {})
        return [f for m, fs in sorted(months.items()) if first_month is None or m >= first_month for f in fs]


class Warehouse(Tables):
    def __init__(self, spark: SparkSession, root: str):
        super().__init__(spark)
        self.root = root.rstrip("/")
        self.files = Files(spark)

    # -- reading

    def pointers(self, owner: str) -> list[str]:
        names = self.files.names(f"{self.root}/{POINTERS}/{owner}")
        return [n for n in names if n.endswith(".json") and n[0] != "."]

    def state(self) -> State:
        state = State()
        for owner in (INTAKE, REFRESH):
            if names := self.pointers(owner):
                one = json.loads(self.files.read(f"{self.root}/{POINTERS}/{owner}/{names[-1]}"))
                state.numbers[owner] = one["number"]
                state.tables.update(one["tables"])
                state.marks.update(one["marks"])
        return state

    def load(self, name: str, floor: datetime | None = None, state: State | None = None) -> DataFrame:
        """Only the folders of months that can hold rows from ``floor`` on are listed and read."""
        state = state or self.state()
        first = month_of(floor) if floor is not None and TABLES[name].time else None
        if name == "dim_users":
            return self._users(state)
        rows = self.folders_as_table(name, state.folders(name, first))
        if name == "mv_refresh_log":
            return folded(rows)
        if name == "system_notifications" and (reads := state.folders("notification_reads")):
            return notifications.with_receipts(rows, self.folders_as_table("notification_reads", reads))
        return rows

    def _users(self, state: State) -> DataFrame:
        """Users as all changes leave them. Those that no folder since the last folding changed are read as they lie."""
        plain, folders = state.folders("dim_users"), state.folders("dim_user_changes")
        # A user is in at most one of the plain rows and the folded ones: folding takes the former away.
        once = [f for f in folders if f == state.marks.get(USERS_FOLDED) and not plain]
        if plain or not once:
            quiet = upserts.as_changes(self.folders_as_table("dim_users", plain))
        else:
            quiet = self.folders_as_table("dim_user_changes", once)
        if len(once) == len(folders):
            return upserts.users(quiet)
        recent = self.folders_as_table("dim_user_changes", [f for f in folders if f not in once])
        touched = recent.select("user_id").distinct()
        changed = upserts.fold_changes(quiet.join(touched, "user_id", "left_semi").unionByName(recent))
        return upserts.users(quiet.join(touched, "user_id", "left_anti").unionByName(changed))

    def folders_as_table(self, name: str, folders: list[str]) -> DataFrame:
        """Rows as they are stored, in today's layout: a column that was renamed since is read under its old name too."""
        spec = TABLES[name]
        if not folders:
            return self.spark.createDataFrame([], spec.schema)
        paths = [f"{self.root}/{f}" for f in folders]
        if not spec.renames:
            rows = self.spark.read.schema(spec.schema).parquet(*paths)
            return maintenance.normalize_currency(rows) if name in RESTATED else rows
        both = T.StructType([*spec.schema.fields, *(T.StructField(old, spec.schema[new].dataType) for old, new in spec.renames.items())])
        rows = self.spark.read.schema(both).parquet(*paths)
        return rows.select(*(F.coalesce(f.name, *(old for old, new in spec.renames.items() if new == f.name)).alias(f.name) for f in spec.schema.fields))

    def rollup(self, name: str, after: datetime | None = None) -> DataFrame:
        """The stored rollup as of its last refresh."""
        return self.read(name, after=after)

    def rollup_size(self, name: str) -> DataFrame:
        """Of the stored rollup."""
        return self.size(name)

    def size(self, name: str) -> DataFrame:
        """One row, ``n``: the rows of a table that is read as it is stored. Counts come from the files' footers."""
        folders = self.state().folders(name)
        if not folders:
            return self.spark.createDataFrame([(0,)], "n bigint")
        # Only the newer reader takes counts from footers; which one is used is settled when the frame is made.
        listed, conf = "spark.sql.sources.useV1SourceList", self.spark.conf
        before = conf.get(listed)
        conf.set(listed, "")
        try:
            rows = self.spark.read.schema(TABLES[name].schema).parquet(*(f"{self.root}/{f}" for f in folders))
        finally:
            conf.set(listed, before)
        return rows.agg(F.count(F.lit(1)).alias("n"))

    def totals(self, name: str) -> DataFrame:
        """From the stored rollup, and the folders that came or went since it was refreshed; other rows are not read."""
        spec = next(r for r in ROLLUPS.values() if r.fact == name and r.where is None)
        state = self.state()
        came, went = self.changed_folders(spec, state)
        if not state.folders(spec.state) or not self.present(went):
            return super().totals(name)
        total = F.col(spec.total) if spec.total else F.lit(None).cast("decimal(28,6)")
        both = self._left_of(spec.name, spec, state).select(F.col(spec.count).alias("n"), total.alias("total"))
        for folders, sign in ((came, 1), (went, -1)):
            if folders:
                one = self.summed(spec, self.folders_as_table(name, folders))
                both = both.unionAll(one.select(F.col("n") * sign, (F.col("total") * sign).cast("decimal(28,6)")))
        return both.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("total").cast("decimal(28,6)").alias("total"))

    def totals_by(self, name: str, column: str) -> DataFrame:
        """From the stored state, likewise."""
        spec = next(r for r in ROLLUPS.values() if r.fact == name and column in r.shares)
        state = self.state()
        came, went = self.changed_folders(spec, state)
        if not state.folders(spec.state) or not self.present(went):
            return super().totals_by(name, column)
        both = self._left_of(spec.state, spec, state)
        for folders, sign in ((came, 1), (went, -1)):
            if folders:
                both = both.unionByName(shares(self.folders_as_table(name, folders), spec, column, sign))
        return shared(both, spec, column)

    def months(self, name: str) -> DataFrame:
        """From the folders' names; no row is read."""
        months = [(m,) for m in sorted(self.state().tables.get(name, {})) if m != UNDATED]
        return self.spark.createDataFrame(months, "month string")

    def _left_of(self, name: str, spec: Rollup, state: State) -> DataFrame:
        """A rollup's rows or state, in the months its fact still has."""
        months = state.tables.get(spec.fact, {})
        return self.folders_as_table(name, [f for m, fs in state.tables.get(name, {}).items() if m in months for f in fs])

    def changed_folders(self, spec: Rollup, state: State) -> tuple[list[str], list[str]]:
        """Folders of a rollup's fact that came and that went since its last refresh. Months without any folder left do not count."""
        now, before = state.tables.get(spec.fact, {}), state.marks.get(f"{INPUTS}{spec.name}", {})
        new, old = ({f for m in months if m in now for f in months[m]} for months in (now, before))
        return sorted(new - old), sorted(old - new)

    def present(self, folders: list[str]) -> bool:
        """Whether the folders are still there, although nothing names them any more."""
        return all(self.files.names(f"{self.root}/{f}") for f in folders)

    def newest(self, name: str, n: int, where: Column | None = None, until: datetime | None = None) -> DataFrame:
        """Month by month from the newest on, until ``n`` rows are found; older folders are not listed or read."""
        months = dict(self.state().tables.get(name, {}))
        if until is not None:
            months = {m: f for m, f in months.items() if m <= month_of(until)}
        folders, found = [], 0
        for month in [UNDATED, *sorted(months.keys() - {UNDATED}, reverse=True)]:
            if found >= n:
                break
            here = months.get(month, [])
            if here:
                rows = self.folders_as_table(name, here)
                found += (rows if where is None else rows.filter(where)).limit(n).count()
                folders += here
        rows = self.folders_as_table(name, folders)
        return rows if where is None else rows.filter(where)

    def folders_holding(self, name: str, folders: list[str], choose: Callable[[DataFrame], DataFrame]) -> list[str]:
        """Which of the folders hold rows that ``choose`` (a filter or semi join) keeps.

        The result has one entry per folder, so it is bounded by their number, not by rows.
        """
        if not folders:
            return []
        rows = self.folders_as_table(name, folders).withColumn("file", F.col("_metadata.file_path"))
        folder = F.regexp_extract("file", f"({name}/[^/]+(/month=[^/]+)?)/[^/]+$", 1)
        return sorted(r.folder for r in choose(rows).select(folder.alias("folder")).distinct().collect())

    # -- writing

    def begin(self) -> Transaction:
        return Transaction(self)

    def vacuum(self, now: datetime, keep: timedelta = KEEP) -> int:
        """Delete pointers but the newest, and folders no pointer left names, if they are older than ``keep``.

        By age, so what a running report or an unfinished write may need stays, however many commits there were. The number of folders deleted.
        """
        if keep < LEAST_KEEP:
            raise ValueError(f"keep at least {LEAST_KEEP}")
        before = now - keep
        used: set[str] = set()
        for owner in (INTAKE, REFRESH):
            home, names = f"{self.root}/{POINTERS}/{owner}", self.pointers(owner)
            old = set(self.files.older(home, before))
            for name in names[:-1]:
                if name in old:
                    self.files.drop(f"{home}/{name}")
            for name in self.pointers(owner):
                tables = json.loads(self.files.read(f"{home}/{name}"))["tables"]
                used.update("/".join(f.split("/")[:2]) for months in tables.values() for fs in months.values() for f in fs)
        gone = [f"{t}/{w}" for t in TABLES for w in self.files.older(f"{self.root}/{t}", before) if f"{t}/{w}" not in used]
        for folder in gone:
            self.files.drop(f"{self.root}/{folder}")
        return len(gone)


class Transaction:
    """Writes to the tables of one pointer that become visible together. Begin it before anything is read that decides what is written."""

    def __init__(self, warehouse: Warehouse):
        self.warehouse = warehouse
        self.base = warehouse.state()
        self.state = self.base.copy()

    def write(self, table: str, df: DataFrame, spread: bool = True) -> dict[str, str]:
        """Write to a new folder split by month; month -> folder. Nothing refers to it yet.

        Without ``spread`` rows are written by the tasks that made them: for rows of one moment in tasks that are neither tiny nor huge.
        """
        spec, home = TABLES[table], f"{table}/{uuid.uuid4().hex}"
        path = f"{self.warehouse.root}/{home}"
        rows = conform(df, spec)
        if spec.time is None:
            rows.hint("rebalance").write.option("compression", "zstd").parquet(path)
            return {UNDATED: home}
        blooms = {f"parquet.bloom.filter.enabled#{c}": "true" for c in spec.lookups}
        # REBALANCE lets AQE split a month that holds most rows over many tasks and merge small ones,
        # so neither a backfill nor a trickle ends in one huge task or in many tiny files.
        by_month = rows.withColumn("month", F.coalesce(month_column(spec.time), F.lit(UNDATED)))
        if spread:
            by_month = by_month.hint("rebalance", "month")
        if spec.lookups:
            by_month = by_month.sortWithinPartitions("month", spec.lookups[0])
        by_month.write.options(**blooms).option("compression", "zstd").partitionBy("month").parquet(path)
        written = [n for n in self.warehouse.files.names(path) if n.startswith("month=")]
        return {n.split("=", 1)[1]: f"{home}/{n}" for n in written}

    def months(self, table: str) -> dict[str, list[str]]:
        """Month -> folders, as this transaction sees them."""
        return dict(self.state.tables.get(table, {}))

    def use(self, table: str, months: dict[str, list[str]]) -> None:
        """Let the table consist of these folders."""
        self.state.tables[table] = {m: f for m, f in months.items() if f}

    def append(self, table: str, df: DataFrame, spread: bool = True) -> None:
        months = self.months(table)
        for month, folder in self.write(table, df, spread).items():
            months[month] = [*months.get(month, []), folder]
        self.use(table, months)

    def replace(self, table: str, df: DataFrame, months: list[str] | None = None) -> None:
        """Put ``df`` in place of the given months (all by default)."""
        kept = {} if months is None else {m: f for m, f in self.months(table).items() if m not in months}
        for month, folder in self.write(table, df).items():
            kept[month] = [*kept.get(month, []), folder]
        self.use(table, kept)

    def replace_folders(self, table: str, folders: list[str], df: DataFrame) -> None:
        """Put ``df`` in place of single folders, leaving the rest of their months alone."""
        gone = set(folders)
        if missing := gone - set(self.state.folders(table)):
            raise ConflictError(f"{table}: {sorted(missing)} are not in the table")
        self.use(table, {m: [f for f in fs if f not in gone] for m, fs in self.months(table).items()})
        self.append(table, df)

    def drop_months(self, table: str, months: list[str]) -> None:
        self.use(table, {m: f for m, f in self.months(table).items() if m not in months})

    def compact(self, table: str, least: int = 2, merge: Callable[[DataFrame], DataFrame] | None = None) -> None:
        """Merge the folders of months that have gathered at least ``least`` of them; ``merge`` puts their rows together."""
        found = {m: f for m, f in self.months(table).items() if len(f) >= max(least, 2)}
        if found:
            rows = self.warehouse.folders_as_table(table, [f for fs in found.values() for f in fs])
            self.replace(table, merge(rows) if merge else rows, list(found))

    def mark(self, name: str, value: object) -> None:
        self.state.marks[name] = value

    def commit(self) -> int:
        """Make the writes visible. Fails with ConflictError if the pointer has moved since the transaction began."""
        changed = [t for t in self.state.tables if self.state.tables[t] != self.base.tables.get(t)]
        owners = {REFRESH if t in REFRESH_TABLES else INTAKE for t in changed}
        if len(owners) > 1:
            raise ValueError(f"{changed} belong to different pointers")
        owner = owners.pop() if owners else INTAKE
        number = self.base.numbers.get(owner, 0) + 1
        own = [t for t in self.state.tables if (t in REFRESH_TABLES) == (owner == REFRESH)]
        marks = {m: v for m, v in self.state.marks.items() if m.startswith(INPUTS) == (owner == REFRESH)}
        files, home = self.warehouse.files, f"{self.warehouse.root}/{POINTERS}/{owner}"
        files.make(home)
        content = {"number": number, "tables": {t: self.state.tables[t] for t in own}, "marks": marks}
        files.put_new(f"{home}/{number:012d}.json", json.dumps(content))
        self.state.numbers[owner] = number
        self.base = self.state.copy()
        return number
