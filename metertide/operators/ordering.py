"""Results that depend on a global order, without passing all rows through one task.

Rows are sorted, which cuts them into range partitions (blocks), and written with the number of
their block and their position in it. Block totals are one row per block, at most
``spark.sql.shuffle.partitions`` rows, so adding them up and broadcasting them is safe at any size.
The blocks are written because a sort that is computed twice may cut them in two ways.
"""

import struct
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from metertide.workspace import materialize

BLOCK, POSITION = "_block", "_position"

#: Equal rows that come more often than this are numbered in parts of so many.
PART_ROWS = 1 << 16
#: Bits that one pass of the median looks at.
DIGIT_BITS = 16
_ROW_HASH, _TIMES, _FIRST = "_row_hash", "_times", "_first"
_LOWER_BITS = (1 << 63) - 1

# Fixed value: row ids of Spark hold the row's place within its partition in the lower 33 bits.
_PLACE_BITS = 33


def in_blocks(df: DataFrame, order: Sequence[Column], name: str = "blocks") -> DataFrame:
    """``df`` with ``_block`` and ``_position`` from 0 in it, both ascending in the given order.

    Rows equal in ``order`` share a block, so ``order`` should tell rows apart.
    """
    row_id = F.col("_row_id")
    placed = materialize(
        df.orderBy(*order).withColumn("_row_id", F.monotonically_increasing_id()), name
    )
    return placed.select(
        *df.columns,
        F.shiftright(row_id, _PLACE_BITS).alias(BLOCK),
        row_id.bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)).alias(POSITION),
    )


def block_starts(totals: DataFrame, total: str, start: str) -> DataFrame:
    """Per block the sum of ``total`` over all earlier blocks. Takes one row per block."""
    earlier = Window.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn(start, F.coalesce(F.sum(total).over(earlier), F.lit(0)))


def with_row_index(
    df: DataFrame, order: Sequence[Column], name: str = "index", part_rows: int = PART_ROWS
) -> DataFrame:
    """``df`` with a dense row index from 0 in the given order; one shuffle of rows, that of the sort.

    Rows equal in ``order`` follow each other by a hash of all columns, so they are spread over blocks
    and come in the same order in every run. A sort can't take wholly equal rows apart, so those that come
    more than ``part_rows`` times are counted, sorted as one row, and numbered in parts of so many rows.
    They are found by counting hashes, of which only partial counts are shuffled. ``df`` is read
    once for that and again for the sort, so it should be cheap or written.
    """
    order = [*order, F.xxhash64(*df.columns)]
    hashed = df.withColumn(_ROW_HASH, F.xxhash64(*df.columns))
    often = materialize(
        hashed.groupBy(_ROW_HASH).count().filter(F.col("count") > part_rows).select(_ROW_HASH),
        "often-repeated",
    )
    if often.isEmpty():
        blocks = in_blocks(df, order, "row-index")
        starts = block_starts(
            blocks.groupBy(BLOCK).agg(F.count(F.lit(1)).alias("_rows")), "_rows", "_start"
        ).drop("_rows")
        index = (F.col("_start") + F.col(POSITION)).alias(name)
        return blocks.join(F.broadcast(starts), BLOCK).select(index, *df.columns)

    # Each hash is that of more than part_rows rows; the few rows that only share it are counted, too.
    single = hashed.join(often, _ROW_HASH, "left_anti").withColumn(_TIMES, F.lit(1).cast("bigint"))
    counted = (
        hashed.join(often, _ROW_HASH, "left_semi")
        .groupBy(*df.columns)
        .agg(F.count(F.lit(1)).alias(_TIMES))
    )
    rows = single.drop(_ROW_HASH).unionByName(counted)
    blocks = in_blocks(rows, order, "row-index")
    starts = block_starts(
        blocks.groupBy(BLOCK).agg(F.sum(_TIMES).alias("_rows")), "_rows", "_start"
    ).drop("_rows")
    earlier = Window.partitionBy(BLOCK).orderBy(POSITION).rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("_start") + F.coalesce(F.sum(_TIMES).over(earlier), F.lit(0))
    numbered = materialize(
        blocks.join(F.broadcast(starts), BLOCK).select(first.alias(_FIRST), _TIMES, *df.columns),
        "row-numbers",
    )
    index, part = F.col(_FIRST), F.lit(part_rows).cast("bigint")
    end = index + F.col(_TIMES)
    # Only where a part begins is dealt out; its rows appear in the task that gets it.
    begins = F.explode(F.sequence(index, end - 1, part)).alias("_begin")
    parts = (
        numbered.filter(F.col(_TIMES) > 1)
        .select(end.alias("_end"), begins, *df.columns)
        .repartition("_begin")
    )
    last = F.least(F.col("_begin") + part, F.col("_end")) - 1
    return (
        numbered.filter(F.col(_TIMES) == 1)
        .select(index.alias(name), *df.columns)
        .unionByName(
            parts.select(F.explode(F.sequence("_begin", last)).alias(name), *df.columns)
        )
    )


def _ordered_bits(value: Column) -> Column:
    """The bits of a double as a whole number of the same order; zeros are one, NaN is the greatest."""
    value = F.when(value == 0, F.lit(0.0)).otherwise(value)
    bits = F.java_method(
        F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value
    ).cast("bigint")
    return F.when(bits < 0, bits.bitwiseXOR(F.lit(_LOWER_BITS))).otherwise(bits)


def _from_ordered_bits(bits: int) -> float:
    return struct.unpack("<d", struct.pack("<q", bits if bits >= 0 else bits ^ _LOWER_BITS))[0]


def digit_counts(numbers: DataFrame, shift: int, within: Sequence[int] | None) -> DataFrame:
    """How many of ``number`` have each value of the bits from ``shift`` up, ``digit``.

    ``within`` names values of the bits above the next ``DIGIT_BITS`` that are looked at; so there are at
    most ``2 ** DIGIT_BITS`` rows for each, whatever the table, and tasks combine before they send.
    """
    if within is not None:
        numbers = numbers.filter(F.shiftright("number", shift + DIGIT_BITS).isin(*within))
    return numbers.groupBy(F.shiftright("number", shift).alias("digit")).agg(
        F.count(F.lit(1)).alias("times")
    )


def exact_median(df: DataFrame, column: str) -> DataFrame:
    """One row ``median``: the middle value as a double, or the mean of the two middle values.

    The built-in exact ``median`` gathers all distinct values in one task, a sort moves all of them. Here
    their bits are written once as ordered whole numbers, and each of four passes counts the next 16
    bits of those that share the bits found so far. Counts are all that is shuffled. The two middle
    ranks are neighbours, so no other value lies between them and one pass serves both. Nulls don't
    count; without values the median is null.
    """
    spark = df.sparkSession
    known = df.filter(F.col(column).isNotNull())
    numbers = materialize(
        known.select(_ordered_bits(F.col(column).cast("double")).alias("number")), "median"
    )
    rows = numbers.count()
    if rows == 0:
        return spark.range(1).select(F.lit(None).cast("double").alias("median"))
    low, high = (rows + 1) // 2, rows // 2 + 1
    earlier, found = 0, None
    so_far = Window.orderBy("digit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for shift in range(64 - DIGIT_BITS, -1, -DIGIT_BITS):
        ranked = digit_counts(numbers, shift, found).withColumn(
            "last", F.lit(earlier) + F.sum("times").over(so_far)
        )
        at = ranked.agg(
            F.min(F.when(F.col("last") >= low, F.col("digit"))).alias("low"),
            F.min(F.when(F.col("last") >= high, F.col("digit"))).alias("high"),
            F.max(F.when(F.col("last") < low, F.col("last"))).alias("earlier"),
        ).first()
        found, earlier = sorted({at.low, at.high}), at.earlier or earlier
    median = sum(_from_ordered_bits(bits) for bits in (found[0], found[-1])) / 2
    return spark.range(1).select(F.lit(median).cast("double").alias("median"))
