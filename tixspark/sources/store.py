"""Stored fact tables: bucketed by ticket, sorted, appended batch by batch (SNK-1..4, SRC-6).

A store is a folder that all nodes share. Each table in it is partitioned by ``batch_id`` and bucketed and sorted
by its key, so joins and latest-per-key over it need no exchange on the fact side, and a point
lookup reads one bucket. All versions of a ticket are in one bucket; a ticket with very many of them is best
read through :class:`LatestSnapshot`, which sees no more of them than the new batches hold. The reference appends to a merge-tree table and leaves repeated
deliveries to the broker; here a batch has an id that grows, and a batch that is delivered again adds nothing:

* a batch is written into its own partition (overwriting what a run that was lost had left there) and then
  entered in the ledger;
* batches up to the ledger's last id are skipped, and readers see those batches only. A store has one writer.

The catalog knows the tables for the session; ``FactStore`` opens a folder again after a
restart and takes the number of buckets and the columns from what is stored.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = "ticket_id"
SAME = "__same"
SPEC = "key string, sort string, buckets int, schema string, listed string, same string"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class FactStore:
    """The stored tables below ``root``. ``buckets`` counts for tables that do not exist yet (default: shuffle partitions)."""

    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self._specs: dict[str, dict] = {}
        self._last: dict[str, int] = {}  # one writer per store: what it has stored it need not read again
        self._prefix = "tix_" + hashlib.sha256(self.root.encode()).hexdigest()[:12]

    # -- tables ---------------------------------------------------------------------

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def name_of(self, name: str) -> str:
        """The catalog's name of a table."""
        return f"{self._prefix}_{name.translate(str.maketrans("/=.", "___"))}"

    def has(self, name: str) -> bool:
        return exists(self.spark, f"{self._path(name)}.spec")

    def spec(self, name: str) -> dict:
        """key, sort, buckets, schema, the listed column and the pair of columns that often agree of a stored table."""
        if name not in self._specs:
            path = f"{self._path(name)}.spec"
            if not exists(self.spark, path):
                raise KeyError(f"no stored table {name!r} in {self.root}")
            self._specs[name] = self.spark.read.schema(SPEC).json(path).first().asDict()
        return self._specs[name]

    def create(self, name: str, schema: T.StructType, key: str = KEY, sort: tuple[str, ...] = (), listed: str | None = None,
               same: tuple[str, str] | None = None) -> None:
        """Enter ``name`` in the store unless it is there already."""
        if name not in self._specs and not self.has(name):
            spec = {"key": key, "sort": ",".join((key, *sort)), "buckets": self.buckets, "schema": schema.json(), "listed": listed,
                    "same": ",".join(same) if same else None}
            self.spark.createDataFrame([tuple(spec.values())], SPEC).coalesce(1).write.mode("overwrite").json(f"{self._path(name)}.spec")
            self._specs[name] = spec

    def open(self, name: str) -> str:
        """The catalog's name of a stored table, which is entered there if this session does not know it."""
        table, spec = self.name_of(name), self.spec(name)
        if not self.spark.catalog.tableExists(table):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in T.StructType.fromJson(json.loads(spec["schema"])).fields)
            columns += f", `{SAME}` boolean" if spec["same"] else ""
            self.spark.sql(
                f"create table {table} ({columns}, batch_id bigint) using parquet "
                f"options (path '{self._path(name)}', partitionOverwriteMode 'dynamic', compression 'zstd') partitioned by (batch_id) "
                f"clustered by ({spec['key']}) sorted by ({spec['sort']}) into {spec['buckets']} buckets"
            )
            if exists(self.spark, self._path(name)):  # stored by an earlier session
                self.spark.sql(f"alter table {table} recover partitions")
        return table

    # -- batches --------------------------------------------------------------------

    def last_batch(self, name: str) -> int:
        """The id of the last batch that is wholly stored, -1 before the first."""
        if name not in self._last:
            path = f"{self._path(name)}.ledger"
            known = exists(self.spark, path)
            self._last[name] = self.spark.read.schema("batch_id long").json(path).agg(F.max("batch_id")).first()[0] if known else -1
        return self._last[name]

    def append(self, name: str, rows: DataFrame, batch_id: int, key: str = KEY, sort: tuple[str, ...] = (), listed: str | None = None,
               same: tuple[str, str] | None = None) -> bool:
        """Store ``rows`` as batch ``batch_id``; False (and nothing written) if that batch or a later one is stored.

        ``listed`` is a column of arrays whose elements are read as rows of their own. ``same`` are two columns: where the
        first equals the second, it is moved and stored once (a description in which nothing had to be redacted)."""
        if batch_id < 0:
            raise ValueError("batch ids begin at 0")
        if batch_id <= self.last_batch(name):
            return False
        self.create(name, rows.schema, key, sort, listed, same)
        table, spec = self.open(name), self.spec(name)
        stored = [c for c in self.spark.table(table).columns if c != "batch_id"]
        if spec["same"]:
            a, b = spec["same"].split(",")
            rows = rows.withColumn(SAME, F.col(a).eqNullSafe(F.col(b))).withColumn(a, F.when(~F.col(SAME), F.col(a)))
        out = rows.select(*stored, F.lit(batch_id).cast("long").alias("batch_id"))
        # A batch has one file in each bucket, unless a bucket is so large that sorting it in one task would spill:
        # adaptive execution shares it between tasks by its advisory size, and each of them writes a file of the bucket.
        out.hint("rebalance", spec["buckets"], spec["key"]).write.insertInto(table, overwrite=True)
        done = self.spark.createDataFrame([(batch_id,)], "batch_id long").coalesce(1)
        done.write.mode("append").json(f"{self._path(name)}.ledger")
        self._last[name] = batch_id
        return True

    def read(self, name: str, after: int = -1) -> DataFrame:
        """The rows of the stored batches later than ``after`` (partitions of others are not read), with batch_id."""
        rows, last = self.spark.table(self.open(name)), self.last_batch(name)
        listed, columns = self.spec(name)["listed"], rows.columns
        rows = rows.where(F.col("batch_id") <= last) if after < 0 else rows.where(F.col("batch_id").between(after + 1, last))
        if self.spec(name)["same"]:
            a, b = self.spec(name)["same"].split(",")
            rows = rows.select(*[F.when(F.col(SAME), F.col(b)).otherwise(F.col(a)).alias(a) if c == a else c for c in columns if c != SAME])
        return rows.select(*[F.explode(c).alias(c) if c == listed else c for c in columns]) if listed else rows


class LatestSnapshot:
    """The latest version per key of a stored table, kept up to date by deltas (AGG-13, WIN-3).

    ``order`` are the columns that decide (greatest first, nulls least). ``advance`` reads the batches after
    the snapshot's mark only, reduces them to one row per key and joins them with the last
    snapshot, bucket by bucket. A late version that is older than the stored one changes nothing; versions of one time
    are told apart by the rest of ``order``. A snapshot counts once its mark is written, so a lost run
    leaves the last one in force.
    """

    def __init__(self, store: FactStore, table: str, order: tuple[str, ...], values: tuple[str, ...], key: str = KEY) -> None:
        self.store, self.table, self.order, self.key = store, table, order, key
        self.values = tuple(dict.fromkeys((*order, *values)))

    @property
    def _marks(self) -> str:
        return f"{self.store.root}/{self.table}.latest/marks"

    def mark(self) -> tuple[int, int]:
        """(number of the last snapshot, last batch in it), (-1, -1) before the first."""
        spark = self.store.spark
        if not exists(spark, self._marks):
            return -1, -1
        m = spark.read.schema("version long, batch_id long").json(self._marks).agg(F.max(F.struct("version", "batch_id")).alias("m")).first()["m"]
        return m["version"], m["batch_id"]

    def _snapshot(self, version: int) -> str:
        return f"{self.table}.latest/v{version}"

    def advance(self) -> bool:
        """Write the next snapshot; False if no batch is new."""
        from ..operators.latest import latest_by_key

        version, done = self.mark()
        last = self.store.last_batch(self.table)
        if last <= done:
            return False
        new = latest_by_key(self.store.read(self.table, done), self.key, list(self.order), list(self.values))
        if version >= 0:
            old = self.store.read(self._snapshot(version)).drop("batch_id")
            rank = lambda side: F.struct(*[F.col(f"{side}.{c}").isNotNull() for c in self.order[:1]], *[F.col(f"{side}.{c}") for c in self.order])
            both = new.alias("n").join(old.alias("o"), F.col(f"n.{self.key}") == F.col(f"o.{self.key}"), "full")
            newer = F.col(f"o.{self.key}").isNull() | (F.col(f"n.{self.key}").isNotNull() & (rank("n") > rank("o")))
            new = both.select(*[F.when(newer, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in (self.key, *self.values)])
        self.store.append(self._snapshot(version + 1), new, 0, self.key)
        mark = self.store.spark.createDataFrame([(version + 1, last)], "version long, batch_id long").coalesce(1)
        mark.write.mode("append").json(self._marks)
        return True

    def read(self) -> DataFrame:
        version, _ = self.mark()
        if version < 0:
            raise ValueError("no snapshot yet: call advance()")
        return self.store.read(self._snapshot(version)).drop("batch_id")

    def forget(self, keep: int = 2) -> None:
        """Delete the files of all snapshots but the last ``keep``."""
        version, _ = self.mark()
        for v in range(version - keep, -1, -1):
            name = self._snapshot(v)
            if not self.store.has(name):
                return
            self.store.spark.sql(f"drop table if exists {self.store.name_of(name)}")
            for suffix in ("", ".ledger", ".spec"):
                delete(self.store.spark, f"{self.store.root}/{name}{suffix}")
