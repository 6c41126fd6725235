"""Message exports and other tables in files."""

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from metertide.functions.strict import read_every_column
from metertide.schemas import MESSAGES

# Quotes inside quoted fields are doubled, and spaces belong to the value: an id with a trailing
# space is another id. Readers and writers must agree on both.
CSV_FORMAT = {
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def read_csv(
    spark: SparkSession,
    paths: str | Sequence[str],
    schema: StructType,
    check_header: bool = False,
    on_error: str = "raise",
) -> DataFrame:
    """CSV files with a header line each, read as one table.

    Columns are taken by position, whatever the header says, unless ``check_header`` asks that the
    names agree. A malformed field raises, whatever columns are used later, or becomes null with
    ``on_error="null"``.
    """
    rows = spark.read.options(**CSV_FORMAT).csv(
        paths if isinstance(paths, str) else list(paths),
        schema=schema,
        header=True,
        enforceSchema=not check_header,
        mode="FAILFAST" if on_error == "raise" else "PERMISSIVE",
    )
    return read_every_column(rows) if on_error == "raise" else rows


def read_messages(
    spark: SparkSession, paths: str | Sequence[str], on_error: str = "raise"
) -> DataFrame:
    """Message exports: a file, a folder, or several of them, in one scan.

    Overlapping exports repeat messages; ``distinct_messages`` removes them.
    """
    return read_csv(spark, paths, MESSAGES, on_error=on_error)


def read_with_repeated_headers(
    spark: SparkSession,
    paths: str | Sequence[str],
    schema: StructType,
    on_error: str = "raise",
) -> DataFrame:
    """CSV files, possibly glued together, in which the header line occurs again between rows.

    Columns are found by the names in the header, which must be the same in all files: one that
    names other columns, or in another order, raises. Rows that repeat the header are skipped before
    the cast to the types in ``schema``, which raises, or gives null with ``on_error="null"``.
    """
    paths = paths if isinstance(paths, str) else list(paths)
    # One file's first line names the columns, so Spark reads no more than that here.
    names = spark.read.options(**CSV_FORMAT).csv(paths, header=True).columns
    text = StructType()
    for name in names:
        text = text.add(name, "string")
    rows = spark.read.options(**CSV_FORMAT).csv(
        paths,
        schema=text,
        header=True,
        enforceSchema=False,
        mode="FAILFAST" if on_error == "raise" else "PERMISSIVE",
    )
    is_header = reduce(and_, [F.col(name).eqNullSafe(F.lit(name)) for name in names])
    strict = on_error == "raise"
    typed = rows.filter(~is_header).select(
        [
            (F.col(f.name).cast(f.dataType) if strict else F.col(f.name).try_cast(f.dataType)).alias(f.name)
            for f in schema
        ]
    )
    return read_every_column(typed) if strict else typed
