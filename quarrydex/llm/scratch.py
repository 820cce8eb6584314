"""Intermediate tables in the shared folder of the cluster, and row keys.

Written tables cut the lineage: a lost executor costs the tasks of the current
stage only. They lie below the session's ``spark.checkpoint.dir``; a folder of our
own is used on a local master only, where that is unset (tests). Tables that nothing
reads are dropped as soon as that is known, the others when the driver ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrydex.sources import delete, shared_dir, temporary

__all__ = ["Scratch", "few", "fresh", "keyed", "shared_dir", "small_batches", "unique_ids", "with_keys"]

#: Bytes and rows of an Arrow batch between Spark and a Python worker: a batch of texts is held several times, in either process.
BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20, "spark.sql.execution.arrow.maxRecordsPerBatch": 1500}


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches for the operators of this package; a setting that the caller has made stays.

    The bound has to be in the session's settings: results are lazy, and Spark reads it when they run.
    """
    conf = spark._jsparkSession.sessionState().conf()
    for key, value in BATCH.items():
        if not conf.contains(key):
            spark.conf.set(key, str(value))


class Scratch:
    """Tables of one run of an operator, below a folder of its own."""

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark = spark
        self.root = temporary(spark, name)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Writes the rows and returns the table, read back with the same schema."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more, and lets Spark delete the shuffle files nothing refers to."""
        for name in names:
            delete(self.spark, f"{self.root}/{name}")
        self.release()

    def release(self) -> None:
        """Spark deletes shuffle files once the driver has collected the objects that stand for them; a driver with memory to spare would otherwise keep them until disks are full."""
        import gc

        gc.collect()
        self.spark._jvm.System.gc()


def unique_ids(docs: DataFrame) -> bool:
    """True if no doc_id is null and none comes twice; reads that column alone."""
    counts = docs.groupBy("doc_id").count()
    row = counts.agg(F.max("count").alias("most"), F.max(F.col("doc_id").isNull()).alias("nulls")).first()
    return row["most"] in (None, 1) and not row["nulls"]


#: Keys up to which a set of them is broadcast (8 bytes each, before overhead); beyond it a join shuffles.
BROADCAST_KEYS = 1_000_000


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def few(keys: DataFrame) -> DataFrame:
    """The keys, to be broadcast if they are at most BROADCAST_KEYS."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def with_keys(scratch: Scratch, docs: DataFrame, key: str) -> tuple[DataFrame, bool]:
    """docs with a key column that is unique and ascends with doc_id, and whether it is doc_id itself.

    It is where doc_id is unique and not null. Else rows are numbered by (doc_id with
    nulls first, text): keys come from sorted range partitions, the rows of each
    numbered after the row counts of those before it.
    """
    if unique_ids(docs):
        return docs.withColumn(key, F.col("doc_id").cast("long")), True
    order = [F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()]
    part, at, salt, before = (fresh(docs, n) for n in ("_part", "_at", "_salt", "_before"))
    ranged = docs.withColumn(salt, F.rand(7)).repartitionByRange(*order, salt).drop(salt).sortWithinPartitions(*order)
    number = F.monotonically_increasing_id()
    parts = scratch.write(ranged.withColumns({part: F.shiftright(number, 33), at: number.bitwiseAND(F.lit((1 << 33) - 1))}), "keyed")
    rows = parts.join(few(starts(parts.groupBy(part).agg(F.count("*").alias("n")), part, before)), part).withColumn(key, F.col(before) + F.col(at))
    return rows.select(*docs.columns, key), False


def starts(sizes: DataFrame, part: str, before: str) -> DataFrame:
    """(part, before): the sum of n over the parts before, from (part, n); a row for each written part, summed in one task."""
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(part, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(before))


def keyed(scratch: Scratch, docs: DataFrame) -> tuple[DataFrame, bool]:
    """(doc_key, doc_id, text) with the key of with_keys."""
    rows, plain = with_keys(scratch, docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")), "doc_key")
    return rows.select("doc_key", "doc_id", "text"), plain
