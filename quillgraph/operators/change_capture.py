"""Processing only new or changed records (log-based change capture).

A log's rows belong to partitions (here: repositories) and have a position in them (when they became known);
a row yields entries, each a key (a path) with a version (what orders the entries of a key) and a value
(null: deleted). A successful run consumes, of its partition's log, the half-open range of positions between
the previous successful run and its own start. Failed, cancelled or crashed runs have no range of their own,
so theirs falls to the next successful run: nothing is skipped, nothing is done twice.

`Capture` is the durable runner, and `changed_files` (p1_found) gets its rows through it. Each batch is first
planned (write-ahead: the ranges of all runs that are new), then its entries are read by these ranges and
merged into the sink, then it is committed; a plan without commit is replayed with its old ranges. The sink
holds the newest version of every key, and drops entries whose version isn't newer: a replay, a re-delivered
or a late row can't be processed twice. A batch reads the log from its first range on, and of the sink the
folders of the partitions that its plan names.

Defined results: rows without workspace, repository, arrival or observation time are no log entries;
null paths are ignored; null or empty arrays and maps say nothing; a changed path without hash has the
hash ''; a path both changed and deleted in one report is deleted; re-delivered reports and runs count
once; reports of one path with equal observed_at are ordered by diff_id; columns not named here are
dropped, so clashing names do no harm; empty tables give an empty result.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.session import shared_folder, staged

REPOSITORY = ["workspace_id", "repo_name"]
#: Width of the time buckets by which one repository's log is split over tasks.
BUCKET_SECONDS = 7 * 86_400
#: Folders of a batch's sink, by partition; and slices of a partition's keys, by which one with many is spread over tasks.
PARTS, SLICES = 16, 256


def successful_runs(runs: DataFrame) -> DataFrame:
    """One row per run with status ok: REPOSITORY, run_id, started_at."""
    ok = runs.where((F.col("status") == "ok") & F.col("run_id").isNotNull() & F.col("started_at").isNotNull())
    ok = ok.dropna(subset=REPOSITORY).groupBy("run_id").agg(F.min(F.struct(*REPOSITORY, "started_at")).alias("r"))
    return ok.select(*[F.col(f"r.{c}") for c in REPOSITORY], "run_id", F.col("r.started_at").alias("started_at"))


def next_run(log: DataFrame, runs: DataFrame, at: str, bucket_seconds: int = BUCKET_SECONDS, by: list[str] = REPOSITORY) -> DataFrame:
    """log with `run` = struct(started_at, run_id) of its partition's (by) first run at or after `at`; others drop.

    An as-of join by time buckets: a window holds one repository's rows of one bucket only, so a
    repository with a third of all rows is spread over many tasks. Rows with no run left in their
    bucket take the first run of the next bucket that has one, found on one row per bucket.
    """
    bucket = F.floor(F.unix_micros(F.col(at).cast("timestamp")) / (bucket_seconds * 1_000_000)).alias("_bucket")
    left = log.withColumn("_bucket", bucket).withColumn("_at", F.col(at))
    kind = dict(runs.dtypes)["started_at"]
    left = left.withColumn("_run", F.lit(None).cast(f"struct<started_at:{kind},run_id:bigint>"))
    right = runs.select(*by, F.col("started_at").alias("_at"), F.struct("started_at", "run_id").alias("_run"))
    right = right.withColumn("_bucket", F.floor(F.unix_micros(F.col("_at").cast("timestamp")) / (bucket_seconds * 1_000_000)))
    both = left.unionByName(right, allowMissingColumns=True)
    order = W.partitionBy(*by, "_bucket").orderBy(F.col("_at").desc(), F.col("_run").desc_nulls_last())
    # with equal times runs come first, with the smallest run_id last: it is the nearest
    found = both.withColumn("run", F.last("_run", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)))
    found = found.where(F.col("_run").isNull()).drop("_run", "_at")
    firsts = right.groupBy(*by, "_bucket").agg(F.min("_run").alias("_first"))
    buckets = left.select(*by, "_bucket").distinct().unionByName(firsts.select(*by, "_bucket")).distinct()
    later = W.partitionBy(*by).orderBy(F.col("_bucket").desc()).rowsBetween(W.unboundedPreceding, -1)
    nexts = buckets.join(firsts, [*by, "_bucket"], "left").select(*by, "_bucket", F.last("_first", ignorenulls=True).over(later).alias("_next"))
    nexts = nexts.where(F.col("_next").isNotNull())
    joined = found.join(nexts, [*by, "_bucket"], "left")
    return joined.withColumn("run", F.coalesce("run", "_next")).drop("_next", "_bucket").where(F.col("run").isNotNull())


def log_entries(diffs: DataFrame, extra: list[str] = ()) -> DataFrame:
    """One row per path that a report names: REPOSITORY, path, offset, hash (null: deleted), and extra columns."""
    hashes = F.coalesce("new_hashes", F.create_map().cast("map<string,string>"))
    paths = F.coalesce("changed_paths", F.array().cast("array<string>"))
    gone = F.coalesce("deleted_paths", F.array().cast("array<string>"))
    changed = F.transform(paths, lambda p: F.struct(p.alias("path"), F.coalesce(F.try_element_at(hashes, p), F.lit("")).alias("hash")))
    deleted = F.transform(gone, lambda p: F.struct(p.alias("path"), F.lit(None).cast("string").alias("hash")))
    kept = F.filter(changed, lambda e: e["path"].isNotNull() & ~F.coalesce(F.array_contains(gone, e["path"]), F.lit(False)))
    entries = diffs.select(*REPOSITORY, "observed_at", "diff_id", *extra, F.explode(F.concat(kept, F.filter(deleted, lambda e: e["path"].isNotNull()))).alias("e"))
    return entries.select(*REPOSITORY, F.col("e.path").alias("path"), F.struct("observed_at", "diff_id").alias("offset"), F.col("e.hash").alias("hash"), *extra)


def reports(diffs: DataFrame) -> DataFrame:
    """The usable rows of file_diff, without clashing columns."""
    kept = diffs.select(*REPOSITORY, "diff_id", "observed_at", "arrived_at", "changed_paths", "deleted_paths", "new_hashes")
    return kept.dropna(subset=[*REPOSITORY, "observed_at", "arrived_at"])


def plan_batches(diffs: DataFrame, runs: DataFrame) -> DataFrame:
    """The batch plan of each successful run: run_id, after (exclusive), upto (inclusive) in arrival time, reports."""
    ok = successful_runs(runs)
    planned = next_run(reports(diffs).groupBy(*REPOSITORY, "diff_id").agg(F.min("arrived_at").alias("arrived_at")), ok, "arrived_at")
    counted = planned.groupBy(F.col("run.run_id").alias("run_id")).agg(F.count(F.lit(1)).alias("reports"))
    before = W.partitionBy(*REPOSITORY).orderBy("started_at", "run_id")
    ranges = ok.select("run_id", *REPOSITORY, F.lag("started_at").over(before).alias("after"), F.col("started_at").alias("upto"))
    return ranges.join(counted, "run_id", "left").select("run_id", *REPOSITORY, "after", "upto", F.coalesce("reports", F.lit(0).cast("bigint")).alias("reports"))


class Capture:
    """The durable runner. Its folder holds

    * plans/N/ranges, the write-ahead plan of batch N: partition, run_id, after (exclusive), upto (inclusive), low;
      one row per run. low is where reading begins: `after`, or the start of an earlier time bucket to which
      rows were added since it was read (late ones), or that of the partition's first rows;
    * plans/N/counts: the log's rows per partition and time bucket, by which late rows are noticed;
    * sink/batch=N/part=P: per key and run the state after (`now`) and before (`then`), `last` for a key's newest;
    * state/N: the newest state of every key after batch N, written by `compact`;
    * done/N: the commit.

    partition, key: columns; position, version, value: a column each. expand(rows) turns log rows into
    entries and keeps the columns partition and run. Plans and commits are small tables; nothing is collected
    but their two ends and the numbers of the sink's parts (at most PARTS).

    Runs of one partition are to be given in the order of their start: one that becomes known only after a
    later one was planned is left out. Positions may come late: the row then counts for the next run.
    """

    def __init__(self, spark: SparkSession, folder: str, partition: list[str], key: list[str], position: str, version: str, value: str, expand: Callable[[DataFrame], DataFrame] = lambda rows: rows, bucket_seconds: int = BUCKET_SECONDS):
        self.spark, self.folder, self.partition, self.key = spark, folder.rstrip("/"), partition, key
        self.position, self.version, self.value, self.expand, self.bucket_seconds = position, version, value, expand, bucket_seconds
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self, what: str) -> list[int]:
        path = self._path(f"{self.folder}/{what}")
        names = [s.getPath().getName() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []
        return sorted(int(n.removeprefix("batch=")) for n in names if n.removeprefix("batch=").isdigit())

    def _publish(self, scratch: str, to: str) -> None:
        """What has been written under another name appears whole or not at all."""
        self._fs.mkdirs(self._path(to).getParent())
        if not self._fs.rename(self._path(scratch), self._path(to)):
            raise OSError(f"{to} can't be written")

    def _plan(self, log: DataFrame, runs: DataFrame, n: int) -> bool:
        """Writes plan N; False if there is no new run."""
        by = self.partition
        runs = runs.select(*by, "run_id", "started_at")
        bucket = F.floor(F.unix_micros(F.col(self.position).cast("timestamp")) / (self.bucket_seconds * 1_000_000)).alias("bucket")
        counts = log.groupBy(*by, bucket).agg(F.count(F.lit(1)).alias("rows"))
        counts = staged(counts, "capture-counts")
        kind = dict(runs.dtypes)["started_at"]
        # just before a bucket
        begin = lambda b: F.timestamp_micros(b * self.bucket_seconds * 1_000_000 - 1).cast(kind)
        starts = counts.groupBy(*by).agg(begin(F.min("bucket")).alias("start"))
        if n:
            old = self.spark.read.parquet(*[f"{self.folder}/plans/{m}/ranges" for m in range(n)])
            last = old.groupBy(*by).agg(F.max(F.struct(F.col("upto").alias("started_at"), "run_id")).alias("planned"))
            fresh = runs.join(last, by, "left").where(F.col("planned").isNull() | (F.struct("started_at", "run_id") > F.col("planned")))
            was = self.spark.read.parquet(f"{self.folder}/plans/{n - 1}/counts").withColumnRenamed("rows", "was")
            grown = counts.join(was, [*by, "bucket"], "left").where(F.coalesce("was", F.lit(0)) != F.col("rows"))
            fresh = fresh.join(grown.groupBy(*by).agg(begin(F.min("bucket")).alias("grown")), by, "left")
        else:
            fresh = runs.withColumn("planned", F.lit(None).cast(f"struct<started_at:{kind},run_id:bigint>")).withColumn("grown", F.lit(None).cast(kind))
        before = F.lag("started_at").over(W.partitionBy(*by).orderBy("started_at", "run_id"))
        # a partition's first run reads from the partition's first row on
        low = F.when(F.col("after").isNotNull(), F.least("after", "grown")).otherwise(F.coalesce("start", "upto"))
        ranges = fresh.join(starts, by, "left").withColumn("upto", F.col("started_at")).withColumn("after", F.coalesce(before, F.col("planned.started_at"))).select(*by, "run_id", "after", "upto", low.alias("low"))
        scratch = f"{self.folder}/scratch-{uuid.uuid4().hex}"
        ranges.write.parquet(f"{scratch}/ranges")
        if self.spark.read.parquet(f"{scratch}/ranges").isEmpty():
            self._fs.delete(self._path(scratch), True)
            return False
        counts.write.parquet(f"{scratch}/counts")
        self._publish(scratch, f"{self.folder}/plans/{n}")
        return True

    def _known(self, before: int, parts: list[int]) -> DataFrame | None:
        """The newest state of the keys in the given parts, before a batch."""
        base = max((m for m in self._numbers("state") if m < before), default=-1)
        folders = [f"{self.folder}/state/{base}"] if base >= 0 else []
        folders += [f"{self.folder}/sink/batch={m}" for m in self._numbers("done") if base < m < before]
        found = None
        for folder in folders:
            one = self.spark.read.parquet(folder).where(F.col("part").isin(parts) & F.col("last")).select("part", *self.partition, *self.key, F.col("now").alias("state"))
            found = one if found is None else found.unionByName(one)
        return found

    def _process(self, log: DataFrame, n: int) -> None:
        by, plan = self.partition, self.spark.read.parquet(f"{self.folder}/plans/{n}/ranges")
        part = F.pmod(F.xxhash64(*by), F.lit(PARTS)).cast("int").alias("part")
        first, last = plan.agg(F.min("low"), F.max("upto")).first()
        rows = log.where((F.col(self.position) > F.lit(first)) & (F.col(self.position) <= F.lit(last)))
        ends = plan.groupBy(*by).agg(F.min("low").alias("_low"), F.max("upto").alias("_upto"))
        rows = rows.join(ends, by).where((F.col(self.position) > F.col("_low")) & (F.col(self.position) <= F.col("_upto"))).drop("_low", "_upto")
        taken = next_run(rows, plan.select(*by, "run_id", F.col("upto").alias("started_at")), self.position, self.bucket_seconds, by)
        state = F.struct(F.col(self.version).alias("version"), F.col(self.value).alias("value"))
        entries = self.expand(taken).select(part, F.pmod(F.xxhash64(*self.key), F.lit(SLICES)).cast("int").alias("slice"), *by, *self.key, "run", state.alias("state"))
        key = ["part", "slice", *by, *self.key]
        # one exchange for all that follows: a partition with a third of all rows is spread by slices of its keys
        newest = entries.repartition("part", "slice").groupBy(*key, "run").agg(F.max("state").alias("state"))
        touched = [r["part"] for r in plan.select(part).distinct().collect()]  # at most PARTS
        known = self._known(n, touched)
        both = newest
        if known is not None:
            old = known.withColumn("slice", F.pmod(F.xxhash64(*self.key), F.lit(SLICES)).cast("int")).repartition("part", "slice").groupBy(*key).agg(F.max("state").alias("state"))
            old = old.join(newest.select(*key).distinct(), key, "left_semi")
            both = newest.unionByName(old, allowMissingColumns=True)
        order = W.partitionBy(*key).orderBy(F.col("run").asc_nulls_first())
        now = F.max("state").over(order.rowsBetween(W.unboundedPreceding, 0))
        then = F.max("state").over(order.rowsBetween(W.unboundedPreceding, -1))
        states = both.select(*key, "run", now.alias("now"), then.alias("then"), F.lead("run").over(order).isNull().alias("last")).where(F.col("run").isNotNull())
        out = states.select("part", *by, *self.key, F.col("run.run_id").alias("run_id"), "now", "then", "last")
        out.write.mode("overwrite").partitionBy("part").parquet(f"{self.folder}/sink/batch={n}")

    def advance(self, log: DataFrame, runs: DataFrame, reached: Callable[[str, int], None] = lambda point, n: None) -> list[int]:
        """Replays what is planned but not committed, then plans and processes the runs that are new.

        Returns the numbers of the batches it committed. reached(point, n) is called when batch n is at
        "plan" (written, nothing processed) and at "sink" (processed, not committed); what it raises leaves
        the folder as a failure there would.
        """
        committed = []
        n = len(self._numbers("plans"))
        for m in [m for m in range(n) if m not in set(self._numbers("done"))] + [n]:
            if m == n:
                if not self._plan(log, runs, n):
                    break
                reached("plan", n)
            self._process(log, m)
            reached("sink", m)
            self._fs.mkdirs(self._path(f"{self.folder}/done/{m}"))
            committed.append(m)
        return committed

    def sink(self) -> DataFrame | None:
        """What the committed batches wrote; None before the first."""
        done = self._numbers("done")
        return self.spark.read.option("basePath", f"{self.folder}/sink").parquet(*[f"{self.folder}/sink/batch={m}" for m in done]) if done else None

    def compact(self) -> None:
        """Writes the newest state of every key as one table, so that later batches needn't read the sinks of all before."""
        done = self._numbers("done")
        if done:
            newest = self._known(done[-1] + 1, list(range(PARTS))).groupBy("part", *self.partition, *self.key).agg(F.max("state").alias("now")).withColumn("last", F.lit(True))
            scratch = f"{self.folder}/scratch-{uuid.uuid4().hex}"
            newest.repartition("part").write.partitionBy("part").parquet(scratch)
            self._publish(scratch, f"{self.folder}/state/{done[-1]}")

    def status(self) -> str:
        """The committed and the pending batches, as JSON."""
        done = self._numbers("done")
        return json.dumps({"done": done, "pending": [n for n in self._numbers("plans") if n not in done]})


def file_capture(spark: SparkSession, folder: str) -> Capture:
    """A runner over the reports of checkouts: what each successful run of a repository has to process."""
    return Capture(spark, folder, REPOSITORY, ["path"], "arrived_at", "offset", "hash", lambda rows: log_entries(rows, ["run"]))


def changes(capture: Capture) -> DataFrame:
    """run_id, repo_relative_path, change (changed or deleted) of the committed batches of a file_capture."""
    sink = capture.sink()
    if sink is None:
        return capture.spark.createDataFrame([], "run_id bigint, repo_relative_path string, change string")
    differs = ~F.col("now.value").eqNullSafe(F.col("then.value"))
    change = F.when(F.col("now.value").isNull(), "deleted").otherwise("changed").alias("change")
    return sink.where(differs).select("run_id", F.col("path").alias("repo_relative_path"), change)


def changed_files(diffs: DataFrame, runs: DataFrame, folder: str | None = None) -> DataFrame:
    """run_id, repo_relative_path, change: all that is new since the folder's last batch is planned, processed and committed.

    Without a folder it begins at nothing, in a new one below the shared folder.
    """
    spark = diffs.sparkSession
    capture = file_capture(spark, folder or f"{shared_folder(spark)}/stage/capture-{uuid.uuid4().hex}")
    capture.advance(reports(diffs), successful_runs(runs))
    return changes(capture)
