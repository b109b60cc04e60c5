"""Cutting lineage: intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder where it is unset and Spark runs in this process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _own[app]


def cut(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Deletes the files of the tables that df reads; cut() wrote them all and no later step reads them."""
    spark = df.sparkSession
    for path in sorted({file.rsplit("/", 1)[0] for file in df.inputFiles()}):
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def cut_bucketed(df: DataFrame, name: str, key: str, n: int) -> DataFrame:
    """As cut(), in n buckets by key: grouping or joining by it later needs no shuffle of this table.

    Only a catalog knows of buckets. The name leaves it as soon as the table is read; its files stay
    as those of cut() do.
    """
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_folder(df.sparkSession)}/{table}"
    df.write.bucketBy(n, key).option("path", path).option("compression", "zstd").saveAsTable(table)
    out = df.sparkSession.table(table)
    out.schema  # resolves the name
    df.sparkSession.sql(f"DROP TABLE {table}")
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(df: DataFrame, text: str) -> int:
    """Bytes of a column's texts, which sizes of partitions and blocks follow from."""
    return df.agg(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0] or 0
