"""One-row summaries, laid out as rows of name and value."""

from pyspark.sql import DataFrame, functions as F

from metertide.operators.ordering import exact_median


def to_long(row: DataFrame, name_column: str, value_type: str) -> DataFrame:
    """A one-row frame as ``(name_column, value)`` rows."""
    same_type = row.select([F.col(name).cast(value_type) for name in row.columns])
    return same_type.unpivot([], same_type.columns, name_column, "value")


def leak_stats(leaks: DataFrame) -> DataFrame:
    row = leaks.agg(
        F.count(F.lit(1)).alias("total_leaks"),
        F.count_if("leak_active").alias("active_leaks"),
        F.avg("leak_amount_litres").alias("avg_leak_amount_litres"),
        F.max("leak_amount_litres").alias("max_leak_amount_litres"),
        F.avg("leak_length_days").alias("avg_leak_length_days"),
        F.max("leak_length_days").alias("max_leak_length_days"),
    )
    return to_long(row, "leakage_stat", "double")


def usage_stats(usage: DataFrame) -> DataFrame:
    """Summary of the usage report; ``avg_daily_flow`` is the mean of the device averages.

    ``usage`` is read twice, as the median writes its own column first, so pass a written table.
    """
    row = usage.agg(
        F.count_if("clipped").alias("clipped_devices"),
        F.avg("avg_daily_flow").alias("avg_daily_flow"),
        F.max("avg_daily_flow").alias("max_daily_flow"),
        F.min("avg_daily_flow").alias("min_daily_flow"),
    )
    median = exact_median(usage, "avg_daily_flow").withColumnRenamed("median", "median_daily_flow")
    # Both sides are one partition of a few rows; together they make one file.
    return (
        to_long(row, "usage_stat", "double")
        .unionByName(to_long(median, "usage_stat", "double"))
        .coalesce(1)
    )


def dropped_device_stats(
    dropped: DataFrame, usage: DataFrame, initial_count: DataFrame
) -> DataFrame:
    """Counts of included, excluded, dropped and reduced devices; no rows if none was touched.

    The three inputs are counted apart and added up, so no rows are ever paired. The differences
    may be negative: a device can be flagged as dropped and still be part of the usage report.
    """
    zero = F.lit(0).cast("bigint")
    counts = (
        initial_count.select(F.col("num_devices").alias("initial"))
        .select("initial", zero.alias("included"), zero.alias("dropped"), zero.alias("reduced"))
        .unionByName(
            usage.agg(F.count(F.lit(1)).alias("included")).withColumns(
                {"initial": zero, "dropped": zero, "reduced": zero}
            )
        )
        .unionByName(
            dropped.agg(
                F.count_if("dropped").alias("dropped"), F.count_if(~F.col("dropped")).alias("reduced")
            ).withColumns({"initial": zero, "included": zero})
        )
    )
    row = (
        counts.agg(*[F.sum(name).alias(name) for name in counts.columns])
        .filter(F.col("dropped") + F.col("reduced") > 0)
        .withColumn("excluded", F.col("initial") - F.col("included"))
        .select(
            F.col("initial").alias("initial_devices"),
            F.col("included").alias("included_devices"),
            F.col("excluded").alias("excluded_devices"),
            F.col("dropped").alias("num_devices_dropped"),
            F.col("reduced").alias("num_devices_reduced"),
            (F.col("excluded") - F.col("dropped")).alias("very_low_count_excluded_devices"),
        )
    )
    return to_long(row, "dropped_stat", "bigint")
