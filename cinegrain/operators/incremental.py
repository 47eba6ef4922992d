"""Processing only new or changed records, with a state that is swapped atomically."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinegrain.session import hadoop_path


def content_hash(*columns: Column) -> Column:
    """A 128-bit hash of the columns; null and empty differ, and neighbouring values can't run together."""
    parts = [F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.md5(F.concat_ws("|", *parts))


class StateStore:
    """Versions of a state table in one folder, and a log of commits of which the last one names the valid version.

    A version is written whole under a new name. It becomes valid by a commit file with the next number, put there by
    a rename that fails if the number is taken: of two runs that started from one state only one can commit, the other
    fails and is repeated from the new state. A run that dies before its commit leaves the old state valid, so its
    records are found again and none is skipped; a run that has committed never sees its records again. What a run
    wrote as its output is named in the same file, so state and output become visible at once. A commit deletes the
    states before the last ``keep`` and what runs that died left.
    """

    def __init__(self, spark: SparkSession, path: str, keep: int = 2):
        self.spark, self.path, self.keep = spark, path, keep

    def _listed(self, folder: str) -> list[str]:
        files, at = hadoop_path(self.spark, folder)
        return sorted(f.getPath().getName() for f in files.listStatus(at)) if files.exists(at) else []

    def _drop(self, name: str) -> None:
        files, at = hadoop_path(self.spark, f"{self.path}/{name}")
        files.delete(at, True)

    def commit_number(self) -> int:
        """The number of the last commit; 0 before the first."""
        return max((int(n) for n in self._listed(f"{self.path}/commits") if n.isdigit()), default=0)

    def _commit(self, number: int) -> dict:
        files, at = hadoop_path(self.spark, f"{self.path}/commits/{number:012}")
        stream = files.open(at)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def version(self) -> str | None:
        number = self.commit_number()
        return self._commit(number)["state"] if number else None

    def read(self, schema) -> DataFrame:
        """The valid state, or an empty one with the schema before the first run."""
        version = self.version()
        if version is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(f"{self.path}/{version}")

    def outputs(self) -> list[str]:
        """Paths of the outputs of all committed runs, in their order."""
        found = (self._commit(int(n))["output"] for n in self._listed(f"{self.path}/commits") if n.isdigit())
        return [f"{self.path}/{name}" for name in found if name]

    def stage(self, rows: DataFrame, what: str = "state", after: int | None = None) -> str:
        """Write a table of the run that follows commit ``after`` (the last one); it isn't valid yet."""
        number = (self.commit_number() if after is None else after) + 1
        name = f"{what}-{number:012}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}")
        return name

    def buckets(self) -> dict[str, str]:
        """Where each bucket of a bucketed state lies; see ``merge_buckets``."""
        number = self.commit_number()
        return self._commit(number).get("buckets") or {} if number else {}

    def swap(self, version: str, output: str | None = None, buckets: dict[str, str] | None = None) -> None:
        """Make a staged version, and an output, valid; fails if another run has committed since it was staged."""
        number = int(version.split("-")[1])
        jvm = self.spark.sparkContext._jvm
        files, new = hadoop_path(self.spark, f"{self.path}/.commit-{uuid.uuid4().hex}")
        stream = files.create(new, True)
        stream.write(bytearray(json.dumps({"state": version, "output": output, "buckets": buckets}).encode()))
        stream.close()
        _, target = hadoop_path(self.spark, f"{self.path}/commits/{number:012}")
        files.mkdirs(target.getParent())
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            if self.commit_number() >= number:
                raise StaleRunError(f"commit {number} was taken by another run")
            context.rename(new, target, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as error:
            files.delete(new, False)
            self._drop(version)
            if "FileAlreadyExists" in str(error):
                raise StaleRunError(f"commit {number} was taken by another run") from error
            raise
        self._tidy(number)

    def _tidy(self, number: int) -> None:
        """Delete what commits before ``number`` left behind: old states, and tables of runs that never committed."""
        last = [self._commit(n) for n in range(max(1, number - self.keep + 1), number + 1)]
        used = {c["state"] for c in last} | {path.split("/")[0] for c in last for path in (c.get("buckets") or {}).values()}
        for name in self._listed(self.path):
            what, _, rest = name.partition("-")
            at = int(rest[:12]) if rest[:12].isdigit() else number
            if at < number and name not in used and not (what == "output" and name == self._commit(at)["output"]):
                self._drop(name)


class StaleRunError(RuntimeError):
    """Another run has committed since this one read the state."""


def changed_records(current: DataFrame, state: DataFrame, key: str, digest: str, order: str | None = None) -> DataFrame:
    """Records of ``current`` that the state lacks or holds with another hash, with ``change`` = added or changed.

    ``state`` has one row per key: the hash that was processed last, so a record that goes back to earlier content is
    changed again. Of several rows of one key in ``current`` the one with the greatest ``order``, then hash, is the
    record (a partially aggregated maximum; no group is gathered); rows with a null key are left out. A null hash is a
    value.
    """
    place = F.struct(*([F.col(order)] if order else []), F.col(digest))
    rows = current.filter(F.col(key).isNotNull())
    newest = rows.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*[F.col(c) for c in current.columns]), place).alias("_row"))
    held = state.select(F.col(key).alias("_key"), F.col(digest).alias("_digest"), F.lit(True).alias("_known"))
    joined = newest.join(held, "_key", "left").filter(F.col("_known").isNull() | ~F.col("_row")[digest].eqNullSafe(F.col("_digest")))
    return joined.select("_row.*", F.when(F.col("_known"), "changed").otherwise("added").alias("change"))


def latest_state(state: DataFrame, todo: DataFrame, key: str, digest: str) -> DataFrame:
    """The state after ``todo`` (one row per key) was processed: its hashes, and those of the keys it doesn't have."""
    kept = state.select(key, digest).join(todo.select(key), key, "left_anti")
    return kept.unionByName(todo.select(key, digest))


def run_selected(store: StateStore, schema, select, advance, process):
    """One run: select, write what is to do, process it, stage the state after it, commit.

    ``select(state)`` gives the records to process. They are written once and read back for both ``process(todo)`` and
    ``advance(state, todo)``, the state after them, so both see the same rows. A DataFrame that ``process`` returns is
    written beside the state and published with it: nothing of a run that fails is ever visible, and nothing is
    published twice. Other effects of ``process`` must be idempotent, since a run that fails after them is repeated.
    Returns the published table, or what ``process`` returned.
    """
    number = store.commit_number()
    state = store.read(schema)
    todo_name = store.stage(select(state), "todo", number)
    todo = store.spark.read.parquet(f"{store.path}/{todo_name}")
    done = process(todo)
    output = store.stage(done, "output", number) if isinstance(done, DataFrame) else None
    store.swap(store.stage(advance(state, todo), "state", number), output)
    store._drop(todo_name)
    return store.spark.read.parquet(f"{store.path}/{output}") if output else done


def merge_buckets(store: StateStore, schema, fresh: DataFrame, key: str, merge, n: int = 64) -> None:
    """Merge rows into a state that lies in ``n`` buckets by a hash of the key, and commit.

    Only the buckets that the fresh rows touch are read, merged and written anew; the others stay where they are, so a
    small batch costs in proportion to itself. ``merge`` gets the old rows of these buckets and the fresh ones.
    """
    number, held = store.commit_number(), store.buckets()
    bucket = F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    touched = sorted(r[0] for r in fresh.select(bucket).distinct().collect())
    paths = [f"{store.path}/{held[str(b)]}" for b in touched if str(b) in held]
    old = store.spark.read.schema(schema).parquet(*paths) if paths else store.spark.createDataFrame([], schema)
    name = f"state-{number + 1:012}-{uuid.uuid4().hex}"
    merge(old, fresh).withColumn("_bucket", bucket).repartition(max(1, len(touched)), "_bucket").write.partitionBy("_bucket").parquet(f"{store.path}/{name}")
    store.swap(name, buckets=held | {str(b): f"{name}/_bucket={b}" for b in touched})


def read_buckets(store: StateStore, schema) -> DataFrame:
    """The whole state of ``merge_buckets``."""
    paths = [f"{store.path}/{path}" for path in store.buckets().values()]
    return store.spark.read.schema(schema).parquet(*paths) if paths else store.spark.createDataFrame([], schema)


def run_incremental(store: StateStore, current: DataFrame, key: str, digest: str, process, order: str | None = None):
    """Process the records of ``current`` that are new or changed against the store's state; see ``run_selected``."""
    schema = current.select(key, digest).schema
    return run_selected(store, schema, lambda state: changed_records(current, state, key, digest, order), lambda state, todo: latest_state(state, todo, key, digest), process)


def baseline_or_changes(store: StateStore, current: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, change) against the last snapshot, which ``current`` then becomes; the first run only sets it.

    ``current`` has one row per key. Values are compared null-safe.
    """
    first = store.version() is None
    schema = current.select(key, value).schema

    def select(state):
        return changed_records(current.select(key, value), state, key, value)

    def process(todo):
        return todo.limit(0) if first else todo

    return run_selected(store, schema, select, lambda state, todo: latest_state(state, todo, key, value), process)


PAGE_STATE = "pageid long, digest string, until_s long"


def newest_versions(pages: DataFrame) -> DataFrame:
    """One row per page: (pageid, revid, first_s) of its newest version.

    That is the row with the highest revid, or the latest fetchedat where no row has a revid. ``first_s`` is the
    version's first fetch in whole seconds. Rows with missing = true, a null pageid or, without revid, an unreadable
    time are no versions. One partially aggregated pass per revid, one per page: no group is gathered.
    """
    seen = F.floor(F.unix_millis(F.expr("try_cast(fetchedat as timestamp)")) / 1000).cast("bigint")
    rows = pages.filter("pageid is not null and not coalesce(missing, false)").select("pageid", "revid", seen.alias("s"), F.expr("try_cast(fetchedat as timestamp)").alias("ts"))
    per_revid = rows.groupBy("pageid", "revid").agg(F.min("s").alias("first_s"), F.max("s").alias("last_s"), F.count("*").alias("n"))
    newest = per_revid.groupBy("pageid").agg(F.max_by(F.struct("revid", "first_s", "last_s"), F.coalesce(F.col("revid"), F.lit(-(2**62)))).alias("v"))
    first = F.when(F.col("v.revid").isNotNull(), F.col("v.first_s")).otherwise(F.col("v.last_s"))
    return newest.select("pageid", F.col("v.revid").alias("revid"), first.alias("first_s")).filter("revid is not null or first_s is not null")


def page_state(entries: DataFrame, runs: DataFrame) -> DataFrame:
    """State rows (pageid, digest, until_s) of what runs with status ok wrote.

    An entry with a revid makes that revid known by its hash; one without makes every version known whose first
    fetch isn't after the entry's fetch in whole seconds. Repeated entries give one row.
    """
    ok = runs.filter("status = 'ok'").select("run_id").distinct()
    second = F.floor(F.unix_millis(F.expr("try_cast(fetchedat as timestamp)")) / 1000).cast("bigint")
    rows = entries.filter("pageid is not null").join(ok, "run_id", "left_semi").select(
        "pageid", F.when(F.col("revid").isNotNull(), content_hash(F.col("revid"))).alias("digest"), F.when(F.col("revid").isNull(), second).alias("until_s")
    )
    return rows.groupBy("pageid", "digest").agg(F.max("until_s").alias("until_s"))


def pending_pages(newest: DataFrame, state: DataFrame) -> DataFrame:
    """(pageid, change, digest, first_s) of the pages whose newest version the state doesn't hold; see ``newest_versions``.

    ``newest`` has one row per page, so the join gives one row per row of the state; the sum over them needs no
    further shuffle, since it has the key of the join.
    """
    current = newest.select("pageid", F.when(F.col("revid").isNotNull(), content_hash(F.col("revid"))).alias("_digest"), "first_s")
    held = state.select("pageid", "digest", "until_s", F.lit(1).alias("_held"))
    done = F.coalesce(F.col("_digest") == F.col("digest"), F.lit(False)) | F.coalesce(F.col("first_s") <= F.col("until_s"), F.lit(False))
    verdict = current.join(held, "pageid", "left").groupBy("pageid").agg(F.max(done).alias("done"), F.count("_held").alias("held"), F.max("_digest").alias("digest"), F.max("first_s").alias("first_s"))
    return verdict.filter("not done").select("pageid", F.when(F.col("held") > 0, "changed").otherwise("added").alias("change"), "digest", "first_s")


def run_pages(store: StateStore, pages: DataFrame) -> DataFrame:
    """One run over the fetched pages: (pageid, change) of the pages whose newest version no run has taken in.

    A version once taken in stays known, as a revision never changes: the state has a row per page and revision, and
    for versions without revision the latest fetch that was taken in.
    """
    newest = newest_versions(pages)

    def advance(state, todo):
        more = todo.select("pageid", "digest", F.when(F.col("digest").isNull(), F.col("first_s")).alias("until_s"))
        return state.select("pageid", "digest", "until_s").unionByName(more).groupBy("pageid", "digest").agg(F.max("until_s").alias("until_s"))

    return run_selected(store, PAGE_STATE, lambda state: pending_pages(newest, state), advance, lambda todo: todo.select("pageid", "change"))
