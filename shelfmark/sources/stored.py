"""Tables that this library keeps: folders of Parquet files, written whole or by partition, and a manifest of what counts.

A job that dies leaves files that no manifest names, so nothing reads them and the
next run writes over them.  Paths are Hadoop paths: any store that Spark reaches.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window as W


def shared_folder(spark: SparkSession, name: str = "work") -> str:
    """A new folder that driver and executors share: below ``spark.checkpoint.dir``, or a temporary one on local masters."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    root = root or tempfile.mkdtemp(prefix="spark-")
    return f"{root}/{name}-{uuid.uuid4()}"


def spread(df: DataFrame) -> DataFrame:
    """Deal out the rows of a scan that has fewer partitions than the cluster has cores, so that work on texts is shared; larger scans stay."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again, for what several plans read."""
    path = shared_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _file_system(spark, path)
    return fs.exists(p)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly below ``path``."""
    fs, p = _file_system(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder and what is below it."""
    fs, p = _file_system(spark, path)
    fs.delete(p, True)


class Manifest:
    """Which numbered parts of a table count: an empty file a version, whose name lists them.  Making a file is one step, so a version counts wholly or not at all."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, f"{path}/manifest"

    def _names(self) -> list[str]:
        fs, p = _file_system(self.spark, self.path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def versions(self) -> list[int]:
        return [int(n.split(".")[0]) for n in self._names()]

    def parts(self) -> list[int]:
        """Numbers of the present version, in order."""
        names = self._names()
        return sorted(int(x) for x in names[-1].split(".")[1].split("_") if x) if names else []

    def commit(self, parts: list[int]) -> None:
        names = self._names()
        number = int(names[-1].split(".")[0]) + 1 if names else 0
        fs, p = _file_system(self.spark, f"{self.path}/{number:010d}.{'_'.join(map(str, parts))}")
        fs.create(p).close()
        # One version before the present stays for readers that have begun.
        for old in names[:-1]:
            remove(self.spark, f"{self.path}/{old}")


def present(spark: SparkSession, path: str, schema: str, parts: list[int], column: str) -> DataFrame:
    """The rows of the given parts of a table that is partitioned by ``column`` first; other folders are not read."""
    if not parts:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).where(F.col(column).isin(*parts))


# Characters that names of partition folders hold as % and two hex digits, besides control characters.
ESCAPED = "\"#%'*/:=?\\\x7f{[]^"


def partition_folder(column: str, value) -> str:
    """The name of the folder of one partition value."""
    if value is None or value == "":
        return f"{column}=__HIVE_DEFAULT_PARTITION__"
    return f"{column}=" + "".join(f"%{ord(c):02X}" if c in ESCAPED or c < " " else c for c in str(value))


def user_bucket(n: int = 16) -> Column:
    """The bucket of a tenant in partitioned tables."""
    return F.pmod(F.xxhash64(F.col("user_id").cast("string")), F.lit(n)).cast("int")


class Partitioned:
    """A table in folders by the values of ``by``; changes rewrite the folders that they touch and leave the files of others.

    ``by`` gives the partition columns and how they follow from a row, ``keyed`` those of them that follow
    from the columns by which rows are replaced or deleted: other folders are not even read.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, by: dict[str, Column], keyed: list[str] | None = None) -> None:
        self.spark, self.path, self.by, self.keyed = spark, path, by, keyed or []
        self.columns = [c for c in schema.names if c not in by]
        kinds = spark.createDataFrame([], schema).select(*[e.alias(c) for c, e in by.items()]).schema
        self.schema = StructType([*[schema[c] for c in self.columns], *kinds])

    def read(self) -> DataFrame:
        """All rows; filters on the partition columns leave folders out."""
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path)

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns(self.by).select(*self.schema.names)

    def _near(self, keys: DataFrame) -> DataFrame:
        """The rows of the folders in which ``keys`` can be."""
        rows = self.read()
        if not self.keyed:
            return rows
        found = keys.select(*[self.by[c].alias(c) for c in self.keyed]).distinct().collect()
        return rows.where(self._any([r.asDict() for r in found]))

    def _any(self, folders: list[dict]) -> Column:
        out = F.lit(False)
        for f in folders:
            one = F.lit(True)
            for c, v in f.items():
                one = one & F.col(c).eqNullSafe(F.lit(v))
            out = out | one
        return out

    def _rewrite(self, folders: list[dict], rows: DataFrame) -> None:
        """``rows`` become the content of ``folders``; those that get none go."""
        names = list(self.by)
        # Settled first: the folders are read for what is written to them.
        rows = settled(rows)
        rows.hint("rebalance", *map(F.col, names)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*names).parquet(self.path)
        left = {tuple(r) for r in rows.select(*names).distinct().collect()}
        for f in folders:
            if tuple(f[c] for c in names) not in left:
                remove(self.spark, "/".join([self.path, *[partition_folder(c, f[c]) for c in names]]))

    def add(self, rows: DataFrame) -> None:
        """More rows, in new files."""
        self._placed(rows).hint("rebalance", *map(F.col, self.by)).write.mode("append").partitionBy(*self.by).parquet(self.path)

    def replace(self, rows: DataFrame, keys: list[str]) -> list[dict]:
        """K3: ``rows`` instead of all rows with the same ``keys``; the folders that were touched."""
        new = settled(self._placed(rows))
        return self._change(self._near(new), new.select(*keys).distinct(), keys, new)

    def delete(self, gone: DataFrame, keys: list[str]) -> list[dict]:
        """K6, K7: drop the rows with the ``keys`` of ``gone``; the folders that were touched."""
        return self._change(self._near(gone), gone.select(*keys).distinct(), keys, None)

    def _change(self, near: DataFrame, gone: DataFrame, keys: list[str], new: DataFrame | None) -> list[dict]:
        names = list(self.by)
        touched = near.join(gone, keys, "left_semi").select(*names)
        if new is not None:
            touched = touched.union(new.select(*names))
        folders = [r.asDict() for r in touched.distinct().collect()]
        if folders:
            rows = self.read().where(self._any(folders)).join(gone, keys, "left_anti").select(*self.schema.names)
            self._rewrite(folders, rows if new is None else rows.unionByName(new))
        return folders

    def retain(self, part: str, least, condition: Column) -> list[dict]:
        """Drop the rows that fail ``condition``: folders below ``least`` go unread, the one at ``least`` is rewritten."""
        names = list(self.by)
        old = [r.asDict() for r in self.read().where(F.col(part) <= F.lit(least)).select(*names).distinct().collect()]
        edge = [f for f in old if f[part] == least]
        self._rewrite(old, self.read().where(self._any(edge)).where(condition))
        return old


class BatchSink:
    """What the batches of a stream write: each batch its own part, and a manifest of the parts that count.

    A batch that runs twice writes its part over again or, once it is in the manifest, nothing.  Rows of
    a batch replace all rows of earlier ones with equal ``keys``; without keys all stay.  After ``most`` parts
    they are merged into ``table``, folders by ``by``, of which only those that the parts touch are rewritten.
    A merge that dies is done again from the same parts, as every row tells its batch.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str] | None = None, by: dict[str, Column] | None = None, most: int = 16) -> None:
        self.spark, self.path, self.keys, self.most = spark, path, keys, most
        self.rows = spark.createDataFrame([], schema).schema
        self.parts = StructType([*self.rows.fields, *spark.createDataFrame([], "batch long").schema.fields])
        self.manifest = Manifest(spark, path)
        self.table = Partitioned(spark, f"{path}/table", self.parts, by or {"part": F.lit(0)})

    def _state(self) -> tuple[list[int], int]:
        """Parts beside the table, and the last batch that is in the table."""
        found = self.manifest.parts()
        return [p for p in found if p >= 0], max([-p - 1 for p in found if p < 0], default=-1)

    def has(self, batch: int) -> bool:
        live, merged = self._state()
        return batch in live or batch <= merged

    def write(self, rows: DataFrame, batch: int) -> None:
        live, merged = self._state()
        if self.has(batch):
            return
        rows.select(*self.rows.names).write.mode("overwrite").parquet(f"{self.path}/parts/batch={batch}")
        mark = [-merged - 1] if merged >= 0 else []
        self.manifest.commit([*mark, *live, batch])
        if len(live) + 1 > self.most:
            self.merge()

    def _tail(self) -> DataFrame:
        return present(self.spark, f"{self.path}/parts", self.parts, self._state()[0], "batch")

    def _latest(self, rows: DataFrame) -> DataFrame:
        if not self.keys:
            return rows
        return rows.withColumn("_last", F.max("batch").over(W.partitionBy(*self.keys))).where("batch = _last").drop("_last")

    def read(self) -> DataFrame:
        """The rows that count, with their batch."""
        _, merged = self._state()
        names = self.parts.names
        # A merge that has not ended left rows of later batches in the table: the parts have them too.
        old = self.table.read().where(F.col("batch") <= merged)
        return self._latest(old.select(*names).unionByName(self._tail().select(*names)))

    def merge(self) -> None:
        live, _ = self._state()
        if not live:
            return
        tail = settled(self.table._placed(self._tail().select(*self.parts.names)))
        names = list(self.table.by)
        folders = [r.asDict() for r in tail.select(*names).distinct().collect()]
        old = self.table.read().where(self.table._any(folders)).where(F.col("batch") < min(live)).select(*self.table.schema.names)
        self.table._rewrite(folders, self._latest(old.unionByName(tail)))
        self.manifest.commit([-max(live) - 1])
        for p in live:
            remove(self.spark, f"{self.path}/parts/batch={p}")
