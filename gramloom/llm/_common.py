"""What the operators of this subpackage share: tables, shared folders, skew-safe joins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A key that holds at least 1/HEAVY of all rows is heavy; there are at most HEAVY such keys,
#: so a table of them may be broadcast whatever the size of the input.
HEAVY = 1000


#: Rows and bytes of an Arrow batch at most: texts may be long, and a task holds a batch or two.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's rows and bytes per Arrow batch; results are lazy, so the settings stay."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows, "10000")) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    if spark.conf.get("gramloom.batch.bytes", None) is None:
        spark.conf.set(size, str(BATCH_BYTES))
        spark.conf.set("gramloom.batch.bytes", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, as set for the session.

    Only where a local session has none (a test) a temporary folder is made and set; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("gramloom.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="gramloom-")
        spark.conf.set("gramloom.checkpoint.dir", base)
    return base.rstrip("/")


class Store:
    """A folder of its own for one run's written tables.

    A written table cuts the lineage: a lost executor costs no recomputation of what stands before it.
    Results are lazy and read from here, so the folder stays until its owner calls ``close``, when they are written.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        bound_batches(spark)
        self.spark, self.path, self.names = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", set()

    def keep(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        """Write ``df`` as Parquet and return the table read back, with the same schema."""
        path = f"{self.path}/{name}"
        self.names.add(name)
        df.write.option("compression", codec).mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def only(self, *names: str) -> None:
        """Removes all tables but ``names``; nothing lazy may read them any more."""
        for name in self.names - set(names):
            self._delete(f"{self.path}/{name}")
        self.names &= set(names)

    def close(self) -> None:
        """Removes the folder; nothing lazy may read from it any more."""
        self._delete(self.path)
        self.names = set()

    def _delete(self, path: str) -> None:
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def lookup_join(left: DataFrame, right: DataFrame, keys: Sequence[str], weight: str, total: int) -> DataFrame:
    """Inner join of ``left`` with ``right``, which has each key once and in ``weight`` the key's number of left rows.

    ``total`` is the number of rows on the left. Keys with at least total/HEAVY rows, of which there
    are at most HEAVY, come by broadcast, and their rows are taken out before the rest is shuffled; no key of
    the rest holds more than total/HEAVY rows, so its shuffle has no hot partition. Where the left has ``weight``
    too, the same for each key, its rows are told apart by that, without a join.
    """
    bar = max(total // HEAVY, 64)
    heavy = right.filter(F.col(weight) >= bar)
    light = right.filter(F.col(weight) < bar)
    if weight in left.columns:
        few, rest = left.filter(F.col(weight) >= bar), left.filter(F.col(weight) < bar)
        return few.join(F.broadcast(heavy.drop(weight)), list(keys)).unionByName(rest.join(light.drop(weight), list(keys)))
    rest = left.join(F.broadcast(heavy.select(*keys)), list(keys), "left_anti")
    return left.join(F.broadcast(heavy), list(keys)).unionByName(rest.join(light, list(keys)))


#: Bits of a filter over keys, whatever the input: 512 KB. A fuller filter lets more rows pass, never fewer.
FILTER_BITS = 1 << 22


def _bit(keys: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(FILTER_BITS))


def bit_filter(df: DataFrame, keys: Sequence[str]) -> np.ndarray:
    """The bits of the hashes of ``keys`` in ``df``, as packed bytes; see ``flagged``."""
    at = _bit(keys) + 1  # Spark's bitmaps number from 1
    parts = df.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in parts:  # FILTER_BITS / 32768 rows at most
        out[(r.part - 1) * len(r.bits) : r.part * len(r.bits)] = np.frombuffer(r.bits, np.uint8)
    return out


def flagged(df: DataFrame, keys: Sequence[str], bits: np.ndarray, name: str = "flag") -> DataFrame:
    """Adds ``name``, last: true for every row whose keys were in the filter's table, and for a few others."""
    shared = df.sparkSession.sparkContext.broadcast(bits)
    df = df.drop(name).withColumn(name, _bit(keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(len(batch.columns) - 1).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1)], batch.schema.names)

    return df.mapInArrow(run, T.StructType([*df.schema.fields[:-1], T.StructField(name, T.BooleanType())]))


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of ``df`` has, made from ``names``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def utf8(text: Column) -> Column:
    """A string column with null read as empty."""
    return F.coalesce(text, F.lit(""))
