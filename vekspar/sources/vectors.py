"""Vector files of benchmarks: (id, emb) rows, and (id, neighbors_id) ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidArgument


def _numbers(df: DataFrame, column: str, element: str) -> DataFrame:
    kind = df.schema[column].dataType
    if not isinstance(kind, T.ArrayType) or not isinstance(kind.elementType, T.NumericType):
        raise InvalidArgument(f"{column} must be a list of numbers", "read vectors")
    return df.withColumn(column, F.col(column).cast(f"array<{element}>"))


def read_vectors(spark: SparkSession, path: str, id_col: str = "id", vector_col: str = "emb") -> DataFrame:
    """Columns id (long), emb (array<float>); only these are read from the file."""
    df = _numbers(spark.read.parquet(path).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("emb")), "emb", "float")
    return df.where(F.col("id").isNotNull() & F.col("emb").isNotNull())


def read_neighbors(spark: SparkSession, path: str, id_col: str = "id", neighbors_col: str = "neighbors_id") -> DataFrame:
    """Columns query_id, rank (from 0), _doc_id: the form that recall() takes."""
    df = _numbers(spark.read.parquet(path).select(F.col(id_col).cast("long").alias("query_id"), F.col(neighbors_col).alias("n")), "n", "bigint")
    return df.select("query_id", F.posexplode("n").alias("rank", "_doc_id")).withColumn("rank", F.col("rank").cast("long"))
