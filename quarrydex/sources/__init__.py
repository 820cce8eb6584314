"""Reading tables, and writing and reading relations."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrydex import model

#: Documents of a file of a relation by document.
FILE_DOCS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. A temporary one stands in on a local master alone."""
    conf = spark.sparkContext.getConf()
    found = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if not found:
        if not conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = spark.conf.get("quarrydex.scratch.dir", None)
    if not found:
        found = f"file://{tempfile.mkdtemp(prefix='quarrydex')}"
        spark.conf.set("quarrydex.scratch.dir", found)
    return found.rstrip("/")


def _at(spark: SparkSession, path: str):
    """The path and its file system, as Hadoop's objects."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def temporary(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, deleted when the driver ends: results that are read from it hold until then."""
    path = f"{shared_dir(spark)}/quarrydex-{name}-{uuid.uuid4().hex}"
    at, system = _at(spark, path)
    system.mkdirs(at)
    system.deleteOnExit(at)
    return path


def delete(spark: SparkSession, path: str) -> None:
    at, system = _at(spark, path)
    system.delete(at, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a written table in the shared folder, whose lineage is its files."""
    path = temporary(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def arranged(df: DataFrame, name: str) -> DataFrame:
    """A relation in its sort order: few files for a segment, none of which holds all of a frequent term.

    Relations by term are sorted into ranges, by samples of df, which should be a written
    table; those by document are dealt by the document's number and sorted.
    """
    by = ["segment_id", *model.SORTED[name]]
    if "term" in by:
        dealt = df.repartitionByRange(*by)
    elif "doc_num" in by:
        dealt = df.repartition("segment_id", F.floor(F.col("doc_num") / FILE_DOCS))
    else:
        dealt = df.repartition("segment_id")
    return dealt.sortWithinPartitions(*by)


def write_relation(df: DataFrame, path: str, name: str, mode: str = "errorifexists") -> None:
    """One relation below the path, partitioned by segment, so that a reader of some segments lists only theirs. "overwrite" replaces the segments that df has."""
    out = arranged(df, name).write.mode(mode).option("partitionOverwriteMode", "dynamic")
    out.partitionBy("segment_id").parquet(f"{path}/{name}")


def persist(relations: dict[str, DataFrame], path: str, mode: str = "errorifexists") -> None:
    """Writes each relation below the path, sorted for term and document scans."""
    for name, df in relations.items():
        write_relation(df, path, name, mode)


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The relations below a path, with their declared schemas; those that were not written are empty."""
    found = {}
    for name, schema in model.SCHEMAS.items():
        at = f"{path}/{name}"
        found[name] = spark.read.schema(schema).parquet(at) if _exists(spark, at) else spark.createDataFrame([], schema)
    return found


def _exists(spark: SparkSession, path: str) -> bool:
    at, system = _at(spark, path)
    return system.exists(at)


def remove(*tables: DataFrame) -> None:
    """Deletes written() tables that nothing reads any more."""
    for df in tables:
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            delete(df.sparkSession, path)
