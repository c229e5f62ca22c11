"""Reading survey files, lookup sheets and snapshots; writing exports."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenfold.functions.nulls import blank_nulls, null_tokens, numeric_columns

_CSV = {"header": "true", "escape": '"', "multiLine": "false"}


def text_schema(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of one file; Spark reads only its first line."""
    return spark.read.options(**_CSV).csv(path).columns


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | None = None,
    numeric: Sequence[str] = (),
    tokens: Sequence[str] = ("NA",),
) -> DataFrame:
    """One CSV source with a declared schema, or all columns as text.

    ``numeric`` columns are coerced after the null tokens are removed.  With
    the default token a blank string stays blank; pass ``("NA", "")`` to make
    blanks missing too.
    """
    reader = spark.read.options(**_CSV).option("nullValue", "\u0000").option("emptyValue", "")
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.csv(path)
    # Spark reads an unquoted blank as NULL; text columns hold it as a blank.
    blanks = {
        f.name: F.coalesce(F.col(f"`{f.name}`"), F.lit(""))
        for f in df.schema.fields
        if isinstance(f.dataType, T.StringType)
    }
    df = null_tokens(df.withColumns(blanks), tokens)
    return numeric_columns(df, numeric) if numeric else df


def read_csv_factors(
    spark: SparkSession, path: str | list[str], numeric: Sequence[str] = (), schema: T.StructType | None = None
) -> DataFrame:
    """CSV with both null tokens; text columns become categories."""
    return read_csv(spark, path, schema=schema, numeric=numeric, tokens=("NA", ""))


def read_survey_files(
    spark: SparkSession, paths: Sequence[str], tokens: Sequence[str] = ("NA",), allow_missing: bool = False
) -> DataFrame:
    """Stack many CSV files by column name.

    Spark aligns the files of one read by position, so files are grouped by
    header and each group is one read; the groups are then united by name.
    The plan grows with the number of distinct headers, not of files.
    """
    if not paths:
        raise ValueError("no survey files given")
    with ThreadPoolExecutor(8) as pool:
        headers = list(pool.map(lambda p: tuple(csv_header(spark, p)), paths))
    groups: dict[tuple, list[str]] = {}
    for path, header in zip(paths, headers):
        groups.setdefault(header, []).append(path)
    if not allow_missing:
        expected = {c.lower() for c in headers[0]}
        for path, header in zip(paths, headers):
            if {c.lower() for c in header} != expected:
                raise ValueError(f"{path} has other columns than {paths[0]}")
    frames = [read_csv(spark, files, schema=text_schema(h), tokens=tokens) for h, files in groups.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), frames)


def read_lookup(spark: SparkSession, paths: Sequence[str], sheet: int = 1) -> DataFrame:
    """A lookup table by sheet number from an ordered list of CSV or Parquet files."""
    path = paths[sheet - 1]
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    return read_csv_factors(spark, path)


def write_snapshot(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def export_csv(df: DataFrame, path: str, blank: bool = True) -> None:
    """CSV with a header and no row names; missing values blank by default, else ``NA``."""
    out = blank_nulls(df) if blank else df
    out.write.mode("overwrite").option("header", "true").option("escape", '"').option(
        "nullValue", "" if blank else "NA"
    ).option("emptyValue", "").csv(path)
