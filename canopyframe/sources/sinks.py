"""Table sinks and their read-back checks."""
from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from canopyframe.operators.ranks import sorted_index
from canopyframe.session import shared_folder


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def write_and_read(df: DataFrame, label: str, by: Sequence[str] = (), fmt: str = "parquet") -> DataFrame:
    spark = df.sparkSession
    path = scratch(spark, label)
    # sorted inside files, whose statistics find the rows of a key: a folder a key would be as many files as keys and tasks
    (df.sortWithinPartitions(*by) if by else df).write.mode("error").format(fmt).save(path)
    return spark.read.format(fmt).schema(df.schema).load(path)


def square_wkt(x0: Column, y0: Column, side: float) -> Column:
    x1, y1 = x0 + side, y0 + side
    return F.format_string("POLYGON((%.2f %.2f, %.2f %.2f, %.2f %.2f, %.2f %.2f, %.2f %.2f))",
                           x0, y0, x1, y0, x1, y1, x0, y1, x0, y0)


def detection_export(trees: DataFrame, pid: str) -> DataFrame:
    """Rows labelled ``T<stand>_<number>`` in id order inside each stand, heights to the centimetre."""
    ranked = sorted_index(trees, ["stand"], pid, "__i")
    return (ranked.withColumn("label", F.format_string("T%03d_%05d", F.col("stand").cast("int"), F.col("__i") + 1))
            .withColumn("z_max", F.round("z_max", 2)).drop("__i", "__i_n"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def require_same_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> None:
    """A paired comparison needs equal key sets on both sides."""
    if not same_rows(a.select(*keys), b.select(*keys)):
        raise ValueError(f"the two tables hold different {list(keys)}")
