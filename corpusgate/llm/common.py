"""What the operators of this subpackage share: reading, checkpoints and the two kinds of words."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgate.functions.shared import shared_folder
from corpusgate.functions.ship import ship
from corpusgate.functions.spread import spread

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 1000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A word between ASCII white space, and a word of ASCII digits and letters and everything above ASCII.
SPACED = "[^\\x20\\x09-\\x0D]+"
PLAIN = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as stored; one of few splits is dealt to all cores."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def materialised(df: DataFrame, what: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it again: the lineage ends there, and a lost
    executor costs no recomputation. The schema is given, so that an empty table can be read as well."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `materialised` wrote and that nothing reads any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def shipped(df: DataFrame) -> DataFrame:
    """df, after sending this package to the executors that will map functions over it.

    Spark's Arrow batches have 10,000 rows unless told otherwise; with texts that may be long they are made smaller."""
    spark = df.sparkSession
    ship(spark)
    if int(spark.conf.get(_BATCH)) > BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    return df
