"""State of ``foreachBatch`` jobs as small tables in the shared folder, one version per micro-batch.

A version is written under its batch number from the version before it, so a micro-batch that is replayed after a failure reads what it read
the first time and writes the same again. Older versions are deleted once two newer ones stand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..sources import readers


def _file_system(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete_path(spark: SparkSession, path: str) -> None:
    hadoop, files = _file_system(spark, path)
    files.delete(hadoop, True)


class Versions:
    """The versions of one state table."""

    def __init__(self, path: str, schema: str | T.StructType) -> None:
        self.path = path.rstrip("/")
        self.schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema

    def numbers(self, spark: SparkSession) -> list[int]:
        if not readers.path_exists(spark, self.path):
            return []
        hadoop, files = _file_system(spark, self.path)
        names = [s.getPath().getName() for s in files.listStatus(hadoop)]
        return sorted(int(n.partition("=")[2]) for n in names if n.startswith("batch_id="))

    def at(self, batch_id: int) -> str:
        return f"{self.path}/batch_id={batch_id}"

    def read(self, spark: SparkSession, batch_id: int) -> DataFrame:
        return spark.read.schema(self.schema).parquet(self.at(batch_id))

    def before(self, spark: SparkSession, batch_id: int | None = None) -> DataFrame:
        """The newest version, or the newest below a batch number; an empty table without one."""
        numbers = [n for n in self.numbers(spark) if batch_id is None or n < batch_id]
        return self.read(spark, numbers[-1]) if numbers else spark.createDataFrame([], self.schema)

    def write(self, df: DataFrame, batch_id: int) -> DataFrame:
        df.select(*self.schema.names).write.mode("overwrite").parquet(self.at(batch_id))
        return self.read(df.sparkSession, batch_id)

    def forget(self, spark: SparkSession, batch_id: int) -> None:
        """Deletes versions that neither this micro-batch nor its replay needs."""
        for n in self.numbers(spark)[:-2]:
            if n < batch_id - 1:
                delete_path(spark, self.at(n))

    def all(self, spark: SparkSession) -> DataFrame:
        """Every version's rows with its ``batch_id``, for tables whose versions are additions."""
        schema = T.StructType([*self.schema.fields, T.StructField("batch_id", T.LongType())])
        if not self.numbers(spark):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).option("basePath", self.path).parquet(self.path)
