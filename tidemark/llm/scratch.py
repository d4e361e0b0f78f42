"""Intermediate tables in the folder that the whole cluster shares.

Writing a table cuts the lineage: an executor that is lost later costs a reread, not a recomputation of
everything before. A table is removed as soon as its owner has made the next one from it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.session import scratch_path


class Scratch:
    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = scratch_path(spark, name)
        self.made = 0

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """The same rows, read back from the shared folder."""
        self.made += 1
        path = f"{self.root}/{name}-{self.made}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that nothing reads any more."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for folder in {file.rsplit("/", 1)[0] for table in tables for file in table.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
