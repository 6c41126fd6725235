"""Runs of device-days put together from stretches of dates.

A stretch is a set of following dates, such as a month. Within it the days of a device are numbered and
gathered to runs once. Neighbouring stretches only meet in their outer runs: the latest of one and the
earliest of the next are one run if their states agree. So a summary of runs per device and stretch
tells the runs of a whole period, whatever its length, without its days.
"""

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from metertide.operators.runs import device_offsets
from metertide.schemas import DAY_FLOWS

STRETCH = "stretch"


def month_of(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def stretch_days(day_flows: DataFrame, stretch: Column) -> DataFrame:
    """Device-days with their ``stretch``, ``flowing``, ``prev_flowing``, ``run`` and ``position``, all counted
    within the stretch from its latest day back. A stretch without a name is not one."""
    latest_first = Window.partitionBy(STRETCH, "device_id").orderBy(F.desc("date"))
    opens_run = F.coalesce(F.col("flowing") != F.col("prev_flowing"), F.lit(True))
    return (
        day_flows.withColumn(STRETCH, stretch)
        .withColumn("flowing", F.col("min_flow") != 0)
        .withColumn("prev_flowing", F.lag("flowing").over(latest_first))
        .withColumn(
            "run",
            F.sum(opens_run.cast("bigint")).over(
                latest_first.rowsBetween(Window.unboundedPreceding, Window.currentRow)
            ),
        )
        .withColumn("position", F.row_number().over(latest_first))
    )


def stretch_runs(days: DataFrame) -> DataFrame:
    """The runs of each device and stretch, from ``stretch_days``, and how many ``runs`` there are."""
    runs = days.groupBy(STRETCH, "device_id", "run", "flowing").agg(
        F.min("date").alias("start"),
        F.max("date").alias("latest"),
        F.count(F.lit(1)).alias("days"),
        F.min("min_flow").alias("amount"),
    )
    whole = Window.partitionBy(STRETCH, "device_id")
    return runs.withColumn("runs", F.max("run").over(whole))


def _outer() -> Column:
    return (F.col("run") == 1) | (F.col("run") == F.col("runs"))


def _latest_stretch_first() -> WindowSpec:
    return Window.partitionBy("device_id").orderBy(F.desc(STRETCH), "run")


def leaks_of_stretches(runs: DataFrame) -> DataFrame:
    """``find_leaks`` of a whole period from its ``stretch_runs``.

    Windows see at most two runs per device and stretch, and the leaks.
    """
    latest_first = _latest_stretch_first()
    before = F.lag(F.struct(STRETCH, "flowing")).over(latest_first)
    goes_on = F.coalesce(
        (F.col("before.flowing") == F.col("flowing")) & (F.col(f"before.{STRETCH}") != F.col(STRETCH)),
        F.lit(False),
    )
    joined = (
        runs.filter(_outer())
        .withColumn("before", before)
        .withColumn(
            "chain",
            F.sum((~goes_on).cast("bigint")).over(
                latest_first.rowsBetween(Window.unboundedPreceding, Window.currentRow)
            ),
        )
        .groupBy("device_id", "chain", "flowing")
        .agg(
            F.min("start").alias("start"),
            F.max("latest").alias("latest"),
            F.sum("days").alias("days"),
            F.min("amount").alias("amount"),
        )
        .drop("chain")
    )
    is_leak = (F.col("amount") != 0) & (F.col("days") > 1)
    inner = runs.filter(~_outer() & is_leak).select(joined.columns)
    latest_run_first = Window.partitionBy("device_id").orderBy(F.desc("latest"))
    return (
        joined.unionByName(inner)
        .withColumn("leak_active", F.first("flowing").over(latest_run_first))
        .filter(is_leak)
        .select(
            "device_id",
            F.col("start").alias("leak_start_date"),
            F.col("days").alias("leak_length_days"),
            F.col("amount").alias("leak_amount_litres"),
            "leak_active",
        )
    )


def number_stretches(days: DataFrame, runs: DataFrame) -> DataFrame:
    """``consecutive_flow_state`` of a whole period from its ``stretch_days`` and ``stretch_runs``.

    The runs tell, for each device and stretch, how many runs come before it; days only look that up.
    """
    latest_first = Window.partitionBy("device_id").orderBy(F.desc(STRETCH))
    earlier_rows = latest_first.rowsBetween(Window.unboundedPreceding, -1)
    summary = (
        runs.filter(_outer())
        .groupBy("device_id", STRETCH)
        .agg(
            F.max("runs").alias("runs"),
            F.max_by("flowing", "start").alias("latest_flowing"),
            F.min_by("flowing", "start").alias("earliest_flowing"),
        )
        .withColumn("later_flowing", F.lag("earliest_flowing").over(latest_first))
        .withColumn("is_latest", F.row_number().over(latest_first) == 1)
        .withColumn(
            "goes_on", F.coalesce(F.col("later_flowing") == F.col("latest_flowing"), F.lit(False)).cast("bigint")
        )
        .withColumn("added", F.col("runs") - F.col("goes_on"))
        .withColumn(
            "skipped", F.coalesce(F.sum("added").over(earlier_rows), F.lit(0)) - F.col("goes_on")
        )
    )
    devices = summary.groupBy("device_id").agg(
        F.sum("added").alias("runs"), F.min_by("earliest_flowing", STRETCH).alias("last_flowing")
    )
    offsets = device_offsets(devices).withColumnRenamed("device_id", "_device")
    known = summary.join(offsets, F.col("device_id").eqNullSafe(F.col("_device"))).select(
        F.col("device_id").alias("_device"),
        F.col(STRETCH).alias("_stretch"),
        "later_flowing", "is_latest", "skipped", "before",
    )
    first_of_device = F.col("is_latest") & (F.col("position") == 1)
    return days.join(
        known,
        F.col("device_id").eqNullSafe(F.col("_device")) & (F.col(STRETCH) == F.col("_stretch")),
    ).select(
        *DAY_FLOWS.fieldNames(),
        "flowing",
        F.when(first_of_device, F.col("before.flowing"))
        .when(F.col("position") == 1, F.col("later_flowing"))
        .otherwise(F.col("prev_flowing"))
        .alias("prev_flowing"),
        F.when(first_of_device, F.col("before.device_id"))
        .otherwise(F.col("device_id"))
        .alias("prev_device_id"),
        (F.col("before.runs") + F.col("skipped") + F.col("run")).alias("consecutive_flow_state"),
    )
