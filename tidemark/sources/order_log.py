"""Readers: the order lifecycle log and the minute-of-day grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import schema as S
from tidemark.functions.columns import finite_or_null, unescape

LOG_COLUMNS = S.ORDER_LOG_CSV.fieldNames()


def read_order_log_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Headered, comma-separated log; quotes are doubled inside quoted fields.

    Columns are found by their header, in any order; others are ignored. Every
    file must carry the same header. Types are declared, not inferred: a blank
    id, and a blank or malformed measure, is NULL; an id that is no whole number
    fails the read, as rows that lose theirs would count as one order. Timestamps
    stay text for :func:`tidemark.operators.lifecycle.parse_lifecycle`. ``multi_line`` accepts
    line breaks inside quotes but makes files unsplittable.
    """
    raw = (
        spark.read.option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
        .option("enforceSchema", False)
        .option("multiLine", multi_line)
        .csv(path)
    )

    def typed(field: T.StructField) -> Column:
        text = F.col(field.name)
        if isinstance(field.dataType, T.StringType):
            return unescape(text).alias(field.name)
        value = text.try_cast(field.dataType)
        if isinstance(field.dataType, T.LongType):
            refused = F.raise_error(F.concat(F.lit(f"{field.name} is no whole number: "), text)).cast("bigint")
            value = F.when(value.isNull() & (F.trim(text) != ""), refused).otherwise(value)
        return value.alias(field.name)

    return normalise(raw.select(*map(typed, S.ORDER_LOG_CSV.fields)))


def read_order_log(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Log from a columnar source."""
    return normalise(spark.read.format(fmt).load(path))


def normalise(log: DataFrame) -> DataFrame:
    """The twelve log columns, ids as LONG, measures as DOUBLE without NaN."""
    casts = {S.STORE: "bigint", S.ORDER: "bigint", "cpo": "double", "cm0": "double"}
    typed = log.select(*[F.col(c).cast(casts[c]).alias(c) if c in casts else F.col(c) for c in LOG_COLUMNS])
    return typed.withColumns({c: finite_or_null(F.col(c)) for c in S.COSTS})


def read_minute_grid_csv(spark: SparkSession, path: str) -> DataFrame:
    """Grid file with one ``H:MM:SS`` per row in column ``hourmin``."""
    grid = spark.read.schema(T.StructType([T.StructField("hourmin", T.StringType())])).option("header", True).csv(path)
    return with_minute(grid.select(F.trim("hourmin").alias("hourmin")))


def read_grid_csv(spark: SparkSession, path: str) -> DataFrame:
    """Grid file with any times of day, as ``H:MM`` or ``H:MM:SS`` in its first column; blank rows do not count."""
    grid = spark.read.schema(T.StructType([T.StructField("hourmin", T.StringType())])).option("header", True).csv(path)
    return with_second(grid.select(F.trim("hourmin").alias("hourmin")).where("hourmin <> ''"))


def with_second(grid: DataFrame) -> DataFrame:
    """Adds the second of the day; a row that is no time of whole seconds fails instead of being dropped."""
    parts = F.split("hourmin", ":")
    second = parts[0].cast("int") * 3600 + parts[1].cast("int") * 60 + F.coalesce(F.get(parts, F.lit(2)).cast("double"), F.lit(0))
    told = F.col("hourmin").rlike(r"^\d{1,2}:[0-5]?\d(:[0-5]?\d([.]0*)?)?$")
    refused = F.raise_error(F.concat(F.lit("the grid has a row that is no time of whole seconds: "), F.col("hourmin")))
    return grid.withColumn("second", F.when(told, second.cast("int")).otherwise(refused.cast("int")))


def minute_grid(spark: SparkSession) -> DataFrame:
    """The regular grid, one row per minute of the day."""
    minute = F.col("id").cast("int")
    hourmin = F.format_string("%d:%02d:00", (minute / 60).cast("int"), minute % 60)
    return spark.range(1440).select(hourmin.alias("hourmin"), minute.alias("minute"))


def with_minute(grid: DataFrame) -> DataFrame:
    """Adds the minute of the day; a row that is no whole minute fails instead of being moved."""
    parts = F.split("hourmin", ":")
    minute = parts[0].cast("int") * 60 + parts[1].cast("int")
    whole = F.coalesce(F.get(parts, F.lit(2)).cast("double"), F.lit(0.0)) == 0
    refused = F.raise_error(F.concat(F.lit("the grid has a time that is no whole minute: "), F.col("hourmin")))
    return grid.withColumn("minute", F.when(whole, minute).otherwise(refused.cast("int")))


def working_minutes(grid: DataFrame, open_hour: int, close_hour: int) -> DataFrame:
    """Grid minutes within [open_hour, close_hour)."""
    hour = (F.col("minute") / 60).cast("int")
    return grid.where((hour >= open_hour) & (hour < close_hour)).withColumn("hour", hour)
