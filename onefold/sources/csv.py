"""CSV and text sources and sinks. Schemas are always declared, never inferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULL_TEXT = "NA"


def _schema(schema: str | T.StructType) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def read_csv(spark: SparkSession, paths: str | Sequence[str], schema: str | T.StructType, header: bool = True) -> DataFrame:
    """Scan one file, a list of files, a folder or a glob; the header of every file is dropped."""
    paths = paths if isinstance(paths, str) else list(paths)
    return spark.read.csv(paths, schema=_schema(schema), header=header, nullValue=NULL_TEXT)


def read_csv_skip_bad(spark: SparkSession, paths: str | Sequence[str], schema: str | T.StructType,
                      columns: Sequence[str] | None = None, header: bool = True) -> DataFrame:
    """As ``read_csv`` without malformed rows (wrong field count or unparsable value).

    Fields are read as text and cast here, and the filter names every field. Which rows count
    as bad then does not depend on the columns used later, as it would in DROPMALFORMED mode.
    """
    full = _schema(schema)
    bad = "__corrupt"
    names = [f.name for f in full.fields]
    text = T.StructType([*[T.StructField(c, T.StringType(), True) for c in names],
                         T.StructField(bad, T.StringType(), True)])
    paths = paths if isinstance(paths, str) else list(paths)
    reader = spark.read.option("columnPruning", False).option("columnNameOfCorruptRecord", bad)
    rows = reader.csv(paths, schema=text, header=header, nullValue=NULL_TEXT, mode="PERMISSIVE")
    typed = {f.name: F.col(f.name).try_cast(f.dataType) for f in full.fields}
    # A size that is never negative: it keeps all fields in the plan without testing anything.
    fine = F.col(bad).isNull() & (F.length(F.concat_ws("", *names)) >= 0)
    for f in full.fields:
        if not isinstance(f.dataType, T.StringType):
            fine = fine & (F.col(f.name).isNull() | typed[f.name].isNotNull())
    return rows.filter(fine).select(*[typed[c].alias(c) for c in (columns or names)])


def write_csv(df: DataFrame, path: str, files: int | None = None, compression: str = "none") -> None:
    """CSV with a header in every file; ``files`` sets their number."""
    out = df.repartition(files) if files else df
    out.write.mode("overwrite").option("header", True).option("nullValue", NULL_TEXT).option(
        "compression", compression).csv(path)


def write_extract(df: DataFrame, columns: Sequence[str], path: str, compression: str = "gzip") -> None:
    """Compressed extract of a few columns, one file per task."""
    write_csv(df.select(*columns), path, compression=compression)


def write_text(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per line (``\\n`` only, so a carriage return stays in its line)."""
    return spark.read.text(path, lineSep="\n")


def read_whole_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: ``path, text``. For many small files."""
    return spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("path"), F.col("value").alias("text"))
