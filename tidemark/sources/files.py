"""Readers and writers: CSV, whitespace text, JSON lines, many paths, first rows, appended results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.scalar import MISSING_MARKS, number


def read_csv(spark: SparkSession, paths: str | list[str], schema: StructType | str | None = None) -> DataFrame:
    """CSV with a header. With a schema one pass; else types are inferred from all rows."""
    r = spark.read.option("header", True)
    r = r.schema(schema) if schema else r.option("inferSchema", True).option("samplingRatio", 1.0)
    return r.csv(paths)


def read_dirty_csv(spark: SparkSession, paths: str | list[str], numbers: list[str]) -> DataFrame:
    """All columns as text, the named ones then parsed; what isn't a number becomes null."""
    df = spark.read.option("header", True).csv(paths)
    return df.withColumns({c: number(F.col(f"`{c}`")) for c in numbers})


def read_whitespace(spark: SparkSession, paths: str | list[str], columns: list[str], with_path: bool = False) -> DataFrame:
    """Text without a header whose columns are parted by white space, named by place. Missing ones are null."""
    lines = spark.read.text(paths)
    lines = lines.withColumn("_path", F.input_file_name()) if with_path else lines
    w = F.split(F.trim("value"), r"\s+")
    return lines.select(*[F.get(w, F.lit(i)).alias(c) for i, c in enumerate(columns)], *(["_path"] if with_path else []))


def read_lines(spark: SparkSession, paths: str | list[str], without: list[str], most: int | None = None) -> DataFrame:
    """Lines that hold none of the given strings, ``most`` of them at most if it is given."""
    df = spark.read.text(paths)
    for s in without:
        df = df.filter(~F.contains("value", F.lit(s)))
    return df.limit(most) if most else df


def read_messages(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """JSON lines with an array ``messages``: one row a message."""
    return spark.read.schema("messages array<string>").json(paths).select(F.posexplode("messages").alias("n", "message"))


def read_entities(spark: SparkSession, catalogue: DataFrame, columns: list[str]) -> DataFrame:
    """Files of many entities read together. catalogue: (code, path), a few thousand rows; each row gets the code of its
    whole path, so that files of one name in several folders stay apart."""
    files = [(r.path, r.code) for r in catalogue.select("code", "path").toLocalIterator()]
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()

    def whole(path: str) -> str:
        p = hadoop.Path(path)
        return p.getFileSystem(conf).makeQualified(p).toUri().toString()

    names = spark.createDataFrame([(whole(p), c) for p, c in files], f"_f string, code {catalogue.schema['code'].dataType.simpleString()}")
    df = read_whitespace(spark, sorted({p for p, _ in files}), columns, with_path=True)
    return df.join(names, F.col("_path") == F.col("_f")).drop("_f", "_path")


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at ``path``, or an empty one of the given schema if there is none."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def date_range(spark: SparkSession, start: str, end: str) -> DataFrame:
    """day: every day from start to end."""
    return spark.sql(f"SELECT explode(sequence(DATE '{start}', DATE '{end}')) AS day")


def write_csv(df: DataFrame, path: str, files: int | None = None) -> None:
    """CSV with a header. ``files=1`` gives one file and is for small results only."""
    (df.coalesce(files) if files else df).write.mode("overwrite").option("header", True).csv(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


__all__ = ["MISSING_MARKS", "append", "date_range", "read_csv", "read_dirty_csv", "read_entities", "read_lines", "read_messages", "read_or_empty", "read_whitespace", "save_model", "write_csv"]
