"""File sources and sinks: CSV with an explicit schema, timestamp parsing,
and the write-then-read-back hand-off of prepared data.

No schema inference: CSV timestamps are declared as strings and parsed with
an explicit pattern, unparseable text becoming null.  Written tables go to the
shared folder named by ``spark.checkpoint.dir`` (never a machine-local one).
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType, TimestampNTZType, TimestampType

from ..session import fresh_path, fresh_table, stored_table

TS_FORMAT = "yyyy-MM-dd HH:mm:ss"


def parse_ts(col: str | Column, fmt: str = TS_FORMAT) -> Column:
    """Text -> TIMESTAMP_NTZ; text that does not match the pattern gives null."""
    c = F.col(col) if isinstance(col, str) else col
    # try_to_timestamp only screens the text (its value is zone-aware and would
    # shift wall-clock times that fall in a daylight-saving gap); the value is
    # parsed zone-free, and only for text that parses
    return F.when(F.try_to_timestamp(c, F.lit(fmt)).isNotNull(), F.to_timestamp_ntz(c, F.lit(fmt)))


def text_schema(schema: StructType) -> tuple[StructType, list[str]]:
    """The schema with timestamp fields declared as strings, and their names."""
    ts = [f.name for f in schema.fields if isinstance(f.dataType, (TimestampNTZType, TimestampType))]
    fields = [StructField(f.name, StringType() if f.name in ts else f.dataType, True) for f in schema.fields]
    return StructType(fields), ts


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, compressed; timestamps written in the parse pattern."""
    # NTZ -> text by cast: 'yyyy-MM-dd HH:mm:ss' for whole seconds, zone-free
    # (date_format would route the value through the session time zone)
    cols = [F.col(f.name).cast("string").alias(f.name) if isinstance(f.dataType, TimestampNTZType)
            else F.date_format(F.col(f.name), TS_FORMAT).alias(f.name) if isinstance(f.dataType, TimestampType)
            else F.col(f.name) for f in df.schema.fields]
    df.select(*cols).write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path)


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """CSV scan with an explicit schema (no inference); timestamps parsed."""
    tschema, ts = text_schema(schema)
    raw = spark.read.schema(tschema).option("header", True).option("mode", "PERMISSIVE").csv(path)
    return raw.select(*[parse_ts(c).alias(c) if c in ts else F.col(c) for c in raw.columns])


CORRUPT = "_corrupt_record"


def read_quarantined(spark: SparkSession, path: str, schema: StructType, header: bool = False) -> tuple[DataFrame, DataFrame]:
    """CSV text in two tables: the rows, and what could not be read.

    A row with too few or too many fields is left out of the rows; the second table
    has its whole text with the reason ``fields`` and no column.  A field whose text
    is not of the schema's type becomes null in its row, and the second table names
    the column, the type as the reason, and the text.  Empty text is missing, not bad.
    The text is read and parsed once.
    """
    text = StructType([StructField(f.name, StringType(), True) for f in schema.fields]
                      + [StructField(CORRUPT, StringType(), True)])
    raw = (spark.read.schema(text).option("header", header).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", CORRUPT).csv(path))
    whole = F.col(CORRUPT).isNull()
    columns, checks = [], []
    for f in schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, StringType):
            columns.append(c)
            continue
        value = parse_ts(c) if isinstance(f.dataType, (TimestampNTZType, TimestampType)) else c.try_cast(f.dataType)
        columns.append(value.cast(f.dataType).alias(f.name))
        checks.append(F.when(whole & c.isNotNull() & value.isNull(), F.struct(
            F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("reason"), c.alias("text"))))
    row = F.when(~whole, F.struct(F.lit(None).cast("string").alias("column_name"), F.lit("fields").alias("reason"),
                                  F.col(CORRUPT).alias("text")))
    bad = F.filter(F.array(row, *checks), lambda x: x.isNotNull())
    parsed = stored_table(raw.select(*columns, whole.alias("_whole"), bad.alias("_bad")), "parsed-text")
    return (parsed.where("_whole").drop("_whole", "_bad"),
            parsed.select(F.explode("_bad").alias("b")).select("b.*"))


def write_prepared(df: DataFrame, name: str, predictors: list[str] | None = None) -> str:
    """Write a prepared table (parquet, typed) into a fresh folder of the shared storage, with
    the predictor column list saved beside it; returns the path."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(f"{path}/rows")
    if predictors is not None:
        meta = df.sparkSession.createDataFrame([(json.dumps(predictors),)], "predictors string")
        meta.coalesce(1).write.json(f"{path}/meta")
    return path


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """A table in ``buckets`` files by ``key``, sorted by it within each, and scanned back.

    Two such tables with equal keys and bucket counts join, and each groups by the
    key, without an exchange.  Rows are dealt by the key before they are written, so
    a bucket is one file.
    """
    table, path = fresh_table(df.sparkSession, name)
    (df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path)
     .format("parquet").saveAsTable(table))
    return df.sparkSession.table(table)


def read_prepared(spark: SparkSession, path: str) -> tuple[DataFrame, list[str] | None]:
    """A prepared table and its predictor list (None only where none was saved with it)."""
    from pyspark.errors import AnalysisException
    try:
        row = spark.read.json(f"{path}/meta").first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        row = None
    return spark.read.parquet(f"{path}/rows"), json.loads(row["predictors"]) if row else None

