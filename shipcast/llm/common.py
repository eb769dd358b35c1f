"""Plumbing shared by the training-data operators."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_path, stored_table

TARGET_BYTES = 16 << 20  # text of a part
MAX_PARTS = 50_000  # beyond that many, parts grow: the driver keeps a record of each


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which every executor reaches."""
    return fresh_path(spark, name)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Cuts the lineage: tasks that run again read the files instead of repeating
    the work that made them.
    """
    return stored_table(df, name)


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def text_bytes(df: DataFrame, column: str = "text") -> int:
    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0


def parts_for(n_bytes: int, target: int = TARGET_BYTES) -> int:
    return max(1, min(-(-n_bytes // target), MAX_PARTS))


def crc32_held(column, modulus: int, remainder: int):
    """Whether crc32(doc_id as text) leaves ``remainder``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def filesystem(path: str):
    """(file system, path inside it) of a shared folder, for readers and writers in tasks."""
    from pyarrow import fs

    if "://" not in path:
        path = path[len("file:"):] if path.startswith("file:") else os.path.abspath(path)
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)
