"""Intermediate tables of the operators, in the folder that the cluster shares for checkpoints."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from burnwatch.plans.staging import shared_dir


def staged(df: DataFrame) -> DataFrame:
    """Write the frame as a Parquet table and read that back: lineage is cut, later reads take only their columns,
    and a lost executor costs a re-read."""
    path = f"{shared_dir(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for name in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(name).getParent()
        if folder.getName().startswith("llm-"):
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
