"""Grouping activity into sessions, kept incrementally.

Method: an incremental session table. Each batch is first cut into local sessions, these are compared with the stored sessions of the same
users within the gap, bridged components are merged, and the affected rows are replaced atomically: a version adds new rows and the
marks of the rows that they replace, and becomes visible by one rename that fails if another writer made that version first.

Scale: local sessions form per user and day, so no task holds more than the minutes of a day of one user; what is merged per user are sessions,
at most 1440 / gap a day, however many events a user has. A batch reads the stored sessions and the counted messages of its own span of time
(files are in order of time, so the rest is skipped by their statistics) and writes what it changed; `compact` folds old versions.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEYS = ["chat_id", "person"]
DAY = 1440


def runs_of_day(minutes: DataFrame, day: list[str], gap: int) -> DataFrame:
    """Rows of minutes (`day` keys, minute) with `run_start`, the first minute of their run, and `ends`, true for the last; the windows hold a day."""
    order = Window.partitionBy(*day).orderBy("minute")
    near = F.col("minute") - F.lag("minute").over(order) < gap
    far = F.lead("minute").over(order) - F.col("minute") >= gap
    cut = minutes.withColumns({"_starts": ~F.coalesce(near, F.lit(False)), "ends": F.coalesce(far, F.lit(True))})
    start = F.max(F.when(F.col("_starts"), F.col("minute"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return cut.withColumn("run_start", start).drop("_starts")


def local_sessions(events: DataFrame, gap: int = 120) -> DataFrame:
    """Sessions per chat, person and UTC day of events (chat_id, person, msg_id, minute), a null person being one person.

    Columns: keys, start_minute, end_minute, first_msg_id, last_msg_id, n_messages. A session starts where `gap` minutes or
    more have passed; events of one minute are ordered by msg_id. Events without minute are left out. No events give no rows.
    """
    day = [*KEYS, "day"]
    spread = events.filter(F.col("minute").isNotNull()).withColumn("day", F.floor(F.col("minute") / DAY)).repartition(*day)
    minutes = spread.groupBy(*day, "minute").agg(F.count("*").alias("n"), F.min("msg_id").alias("lo"), F.max("msg_id").alias("hi"))
    return runs_of_day(minutes, day, gap).groupBy(*day, "run_start").agg(
        F.max("minute").alias("end_minute"), F.max(F.when(F.col("minute") == F.col("run_start"), F.col("lo"))).alias("first_msg_id"),
        F.max(F.when(F.col("ends"), F.col("hi"))).alias("last_msg_id"), F.sum("n").alias("n_messages"),
    ).select(*KEYS, F.col("run_start").alias("start_minute"), "end_minute", "first_msg_id", "last_msg_id", "n_messages")


def _components(parts: DataFrame, gap: int) -> DataFrame:
    """`parts` with `_part`, the number of the merged session that each belongs to among those of its keys."""
    order = Window.partitionBy(*KEYS).orderBy("start_minute", "end_minute")
    reached = F.max("end_minute").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.coalesce(F.col("start_minute") - reached >= gap, F.lit(True)).cast("int")
    return parts.withColumn("_starts", starts).withColumn("_part", F.sum("_starts").over(order)).drop("_starts")


def _bounds() -> list[Column]:
    return [
        F.min("start_minute").alias("start_minute"),
        F.max("end_minute").alias("end_minute"),
        F.min(F.struct("start_minute", "first_msg_id"))["first_msg_id"].alias("first_msg_id"),
        F.max(F.struct("end_minute", "last_msg_id"))["last_msg_id"].alias("last_msg_id"),
        F.sum("n_messages").alias("n_messages"),
    ]


def merge_sessions(parts: DataFrame, gap: int = 120) -> DataFrame:
    """Sessions from parts of sessions that overlap or lie within the gap; parts must not share events."""
    return _components(parts, gap).groupBy(*KEYS, "_part").agg(*_bounds()).drop("_part")


class SessionTable:
    """Sessions and the ledger of counted messages below `path`, both in the folder that all executors share.

    A version lists folders of session rows and of the ledger. A session row has the version that wrote it (`born`); a row with `dead` set marks the
    row of its keys, start and birth as replaced. `person` is the type of that column, STRING or BIGINT.
    """

    def __init__(self, spark: SparkSession, path: str, gap: int = 120, person: str = "STRING", compact_after: int = 16):
        self.spark, self.path, self.gap, self.compact_after = spark, path.rstrip("/"), gap, compact_after
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._at = lambda p: hadoop.Path(f"{self.path}/{p}")
        self._fs = hadoop.FileSystem.get(self._at("").toUri(), spark._jsc.hadoopConfiguration())
        self.sessions = f"chat_id BIGINT, person {person}, start_minute BIGINT, end_minute BIGINT, first_msg_id BIGINT, last_msg_id BIGINT, n_messages BIGINT, born BIGINT, dead BOOLEAN"
        self.ledger = "chat_id BIGINT, msg_id BIGINT, minute BIGINT"

    def version(self) -> int:
        """The newest version, 0 before the first batch."""
        if not self._fs.exists(self._at("versions")):
            return 0
        names = [f.getPath().getName() for f in self._fs.listStatus(self._at("versions"))]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def _manifest(self, version: int) -> dict:
        if not version:
            return {"sessions": [], "ledger": []}
        return json.loads(self.spark.read.text(f"{self.path}/versions/{version:010d}", wholetext=True).first()[0])

    def _commit(self, version: int, manifest: dict) -> bool:
        """Make `manifest` that version; False if another writer made it first, which the rename tells since it never replaces a file."""
        self._fs.mkdirs(self._at("versions"))
        temporary = self._at(f"versions/new-{uuid.uuid4().hex}")
        out = self._fs.create(temporary, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        none = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at("").toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(temporary, self._at(f"versions/{version:010d}"), none)
        except Exception:  # the file is there
            if not self._fs.exists(self._at(f"versions/{version:010d}")):
                raise
            self._fs.delete(temporary, False)
            return False
        return True

    def _rows(self, paths: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _live(self, manifest: dict, span: tuple[int, int] | None = None) -> DataFrame:
        """Session rows that no later version replaced, of a span of minutes if given."""
        rows = self._rows(manifest["sessions"], self.sessions)
        if span is not None:
            rows = rows.filter((F.col("end_minute") > span[0] - self.gap) & (F.col("start_minute") < span[1] + self.gap))
        if len(manifest["sessions"]) < 2:
            return rows.filter(~F.col("dead")).drop("dead")
        live, gone = rows.filter(~F.col("dead")).alias("s"), rows.filter("dead").select("chat_id", "person", "start_minute", "born").alias("g")
        same = [F.col(f"s.{c}") == F.col(f"g.{c}") for c in ("chat_id", "start_minute", "born")] + [F.col("s.person").eqNullSafe(F.col("g.person"))]
        return live.join(gone, same, "left_anti").drop("dead")

    def read(self) -> DataFrame:
        return self._live(self._manifest(self.version())).drop("born")

    def apply(self, batch: DataFrame, tries: int = 5) -> None:
        """Add a batch of events (chat_id, person, msg_id, minute). Messages counted before, or twice in the batch, count once; copies of a message agree
        on their minute. If another writer commits meanwhile, the batch is merged again with what that one stored."""
        once = batch.filter(F.col("minute").isNotNull()).groupBy("chat_id", "msg_id").agg(F.min("minute").alias("minute"), F.min("person").alias("person"))
        for _ in range(tries):
            before = self.version()
            manifest, token = self._manifest(before), uuid.uuid4().hex[:12]
            counted = f"{self.path}/ledger/{token}"
            fresh = once
            if manifest["ledger"]:
                span = once.agg(F.min("minute"), F.max("minute")).first()
                known = self._rows(manifest["ledger"], self.ledger).filter(F.col("minute").between(span[0] or 0, span[1] or 0))
                fresh = once.join(known.select("chat_id", "msg_id"), ["chat_id", "msg_id"], "left_anti")
            fresh.write.parquet(counted)
            fresh = self.spark.read.parquet(counted)
            lo, hi = fresh.agg(F.min("minute"), F.max("minute")).first()
            if lo is None:
                return
            target = f"{self.path}/sessions/{token}"
            self._merged(local_sessions(fresh, self.gap), self._live(manifest, (lo, hi)), before + 1).write.parquet(target)
            after = {"sessions": [*manifest["sessions"], target], "ledger": [*manifest["ledger"], counted]}
            if self._commit(before + 1, after):
                if len(after["sessions"]) >= self.compact_after:
                    self.compact()
                return
            for folder in (counted, target):
                self._fs.delete(self._at(folder.removeprefix(f"{self.path}/")), True)
        raise RuntimeError(f"{tries} other writers committed first")

    def _merged(self, local: DataFrame, stored: DataFrame, version: int) -> DataFrame:
        """The rows of a new version: sessions that hold local ones, and marks of the stored ones that went into them."""
        both = local.withColumn("born", F.lit(None).cast("bigint")).unionByName(stored)
        old = F.collect_list(F.when(F.col("born").isNotNull(), F.struct("start_minute", "end_minute", "first_msg_id", "last_msg_id", "n_messages", "born")))
        merged = _components(both, self.gap).groupBy(*KEYS, "_part").agg(*_bounds(), F.count_if(F.col("born").isNull()).alias("_fresh"), old.alias("_old")).filter("_fresh > 0")
        row = F.struct("start_minute", "end_minute", "first_msg_id", "last_msg_id", "n_messages", F.lit(version).cast("bigint").alias("born"), F.lit(False).alias("dead"))
        gone = F.transform("_old", lambda o: o.withField("dead", F.lit(True)))
        rows = merged.select(*KEYS, F.inline(F.concat(F.array(row), gone)))
        return rows.sortWithinPartitions("start_minute")

    def compact(self) -> None:
        """Fold all versions into one; another writer that commits first wins, and the next call folds its rows too."""
        before = self.version()
        manifest, token = self._manifest(before), uuid.uuid4().hex[:12]
        if len(manifest["sessions"]) < 2:
            return
        target, counted = f"{self.path}/sessions/{token}", f"{self.path}/ledger/{token}"
        self._live(manifest).withColumn("dead", F.lit(False)).repartitionByRange("start_minute").sortWithinPartitions("start_minute").write.parquet(target)
        self._rows(manifest["ledger"], self.ledger).repartitionByRange("minute").sortWithinPartitions("minute").write.parquet(counted)
        self._commit(before + 1, {"sessions": [target], "ledger": [counted]})


def sessions_of_batches(rows: DataFrame, path: str, loads: int = 3, gap: int = 120) -> DataFrame:
    """Session table of dated rows, loaded in `loads` batches in order of `loaded_at` as they came in.

    `rows` must be stored, since each batch reads it. Rows without load time come with the first batch.
    """
    table = SessionTable(rows.sparkSession, path, gap, dict(rows.dtypes)["person"])
    second = F.coalesce(F.unix_timestamp(F.col("loaded_at").cast("timestamp")), F.lit(0))
    cuts = rows.select(F.percentile_approx(second, [i / loads for i in range(1, loads)])).first()[0] or []
    edges = [None, *sorted(set(cuts)), None]
    for lo, hi in zip(edges, edges[1:], strict=False):
        part = rows if lo is None else rows.filter(second > lo)
        table.apply(part if hi is None else part.filter(second <= hi))
    return table.read()
