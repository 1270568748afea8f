"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.frames import forget, materialize, once, shared_dir, tidy  # noqa: F401  for this subpackage's modules
from ..functions.text import let  # noqa: F401

#: White space between words, and a word, as Java and Python regular expressions.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def total(values: Column, kind: str = "bigint") -> Column:
    return F.aggregate(values, F.lit(0).cast(kind), lambda acc, x: acc + x)


def packed(df: DataFrame, name: str = "_m") -> DataFrame:
    """All columns as one struct, so that none can clash with an operator's own."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name))


def unpacked(df: DataFrame, names: list[str], name: str = "_m") -> DataFrame:
    return df.select(*[F.col(name)[c].alias(c) for c in names])


def row_key(row: Column, kind: StructType) -> Column:
    """128 bits that tell different rows (a struct) apart; equal rows have equal keys, however often a table is read."""
    fields = [F.to_json(F.struct(row[f.name])) if "map<" in f.dataType.simpleString() else row[f.name] for f in kind.fields]
    nulls = F.array(*[x.isNull() for x in fields])
    return F.struct(F.xxhash64(nulls, *fields).alias("a"), F.xxhash64(F.lit(1), nulls, *fields).alias("b"))


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def n_words(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+", -1), "")).cast("bigint")


def slices(batch: pa.RecordBatch, column: int, rows: int = 5000, size: int = 20_000_000) -> Iterator[pa.RecordBatch]:
    """A batch in parts of so many rows and about so many bytes of a column at most."""
    sizes, at = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False), 0
    while at < batch.num_rows:
        held = np.cumsum(sizes[at : at + rows])
        n = max(1, int(np.searchsorted(held, size, "right")))
        yield batch.slice(at, n)
        at += n
