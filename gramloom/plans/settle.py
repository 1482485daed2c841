"""Cutting a plan's lineage, and dense numbers without a global sort in one task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_OWN_FOLDER = "gramloom.tables.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or else the context's checkpoint folder.

    Only a local session without either gets a temporary folder; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_OWN_FOLDER, None)
    if not base:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        master = spark.sparkContext.master
        if given.isDefined():
            base = given.get()
        elif master.startswith("local") and not master.startswith("local-cluster"):
            base = "file://" + tempfile.mkdtemp(prefix="gramloom-")
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.conf.set(_OWN_FOLDER, base)
    return base.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, read by column, and there when executors go.

    Tables stay until the folder ``tables`` within the shared one is removed, which its owner may do between jobs.
    """
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by keys to the session's number of shuffle partitions, not fewer however few its bytes: for costly expressions."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


#: Parts of a hot key.
SALTS = 16


def salted_join(few: DataFrame, many: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Inner join in which each key's rows of ``many`` are dealt by ``by`` over SALTS parts, and each part meets all of the key's rows of ``few``."""
    salt = "_salt"
    while salt in few.columns or salt in many.columns:
        salt += "_"
    parts = few.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return parts.join(many.withColumn(salt, F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")), [*keys, salt]).drop(salt)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of ``df`` has, made from ``names``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def numbered(df: DataFrame, order: list[Column], name: str = "id", start: int = 0) -> DataFrame:
    """Adds 0, 1, 2, ... by ``order``: rows are dealt out by range and sorted in their parts; only the parts' sizes are summed in one place."""
    at, part, count, base = unused(df, "_at", "_part", "_count", "_base")
    parts = settled(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()))
    number = F.shiftright(F.col(at), 33)
    sizes = parts.groupBy(number.alias(part)).agg(F.count("*").alias(count))
    before = F.coalesce(F.sum(count).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a row for each partition
    bases = F.broadcast(sizes.select(part, (before + start).alias(base)))
    out = parts.withColumn(part, number).join(bases, part).withColumn(name, F.col(base) + F.col(at) - F.shiftleft(F.col(part), 33))
    return out.drop(part, base, at)
