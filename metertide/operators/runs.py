"""Runs of device-days with the same flow state, and leaks among them."""

from pyspark.sql import DataFrame, Window, WindowSpec, functions as F

from metertide.operators.ordering import BLOCK, block_starts, in_blocks
from metertide.schemas import DAY_FLOWS
from metertide.workspace import materialize_by_key


def _latest_first() -> WindowSpec:
    return Window.partitionBy("device_id").orderBy(F.desc("date"))


def flow_runs(day_flows: DataFrame) -> DataFrame:
    """Device-days with ``flowing, prev_flowing, run``, the run counted per device.

    Days are read from the latest to the earliest. A run is a stretch of *reported* days with the
    same state: a day without messages does not break it, a day without any reading does. A device
    has one row per date, so its window holds at most the days of the period, however many messages
    it sends.
    """
    opens_run = F.coalesce(F.col("flowing") != F.col("prev_flowing"), F.lit(True))
    return (
        day_flows.withColumn("flowing", F.col("min_flow") != 0)
        .withColumn("prev_flowing", F.lag("flowing").over(_latest_first()))
        .withColumn(
            "run",
            F.sum(opens_run.cast("bigint")).over(
                _latest_first().rowsBetween(Window.unboundedPreceding, Window.currentRow)
            ),
        )
    )


def stored_runs(day_flows: DataFrame) -> DataFrame:
    """``flow_runs`` with ``position`` and ``last_day``, written in buckets by device.

    The one shuffle and window of the days; what follows by device starts from here without another.
    """
    position = F.row_number().over(_latest_first())
    last = F.lead("date").over(_latest_first()).isNull()
    days = flow_runs(day_flows).withColumn("position", position).withColumn("last_day", last)
    return materialize_by_key(days, "device_id", "position", "device-days")


def consecutive_flow_state(day_flows: DataFrame) -> DataFrame:
    """Device-days with a run number that goes on from device to device.

    The numbering, ``prev_flowing`` and ``prev_device_id`` are those of one table sorted by device
    and date, both descending. Only one row per device takes part in the global order. The days are
    shuffled and windowed once, and written in buckets by device, where the join finds them.
    """
    return number_runs(stored_runs(day_flows))


def number_runs(days: DataFrame) -> DataFrame:
    """``consecutive_flow_state`` of ``stored_runs``."""
    offsets = device_offsets(
        days.filter("last_day").select(
            "device_id", F.col("run").alias("runs"), F.col("flowing").alias("last_flowing")
        )
    )
    # A plain equality join would lose the device without an id, a null-safe one would shuffle the
    # days again. There is at most one such device, so its row comes from a scalar subquery.
    no_id = offsets.filter(F.col("device_id").isNull()).select("before").scalar()
    before = F.when(F.col("device_id").isNull(), no_id).otherwise(F.col("before"))
    first_of_device = F.col("position") == 1
    return (
        days.join(offsets, "device_id", "left")
        .withColumn("before", before)
        .select(
            *DAY_FLOWS.fieldNames(),
            "flowing",
            F.when(first_of_device, F.col("before.flowing"))
            .otherwise(F.col("prev_flowing"))
            .alias("prev_flowing"),
            F.when(first_of_device, F.col("before.device_id"))
            .otherwise(F.col("device_id"))
            .alias("prev_device_id"),
            (F.col("before.runs") + F.col("run")).alias("consecutive_flow_state"),
        )
    )


def device_offsets(devices: DataFrame) -> DataFrame:
    """Per device what comes before it: number of runs, last device, state of its last row.

    Takes the number of ``runs`` of each device and the state of its earliest day, ``last_flowing``.
    """
    order = [F.desc("device_id")]
    devices = in_blocks(devices, order, "device-blocks")
    # The null id sorts last of all, so no block that follows another block's rows needs it here.
    totals = devices.groupBy(BLOCK).agg(
        F.sum("runs").alias("block_runs"),
        F.min_by(F.struct("device_id", "last_flowing"), "device_id").alias("block_last"),
    )
    blocks = block_starts(totals, "block_runs", "start").select(
        BLOCK, "start", F.lag("block_last").over(Window.orderBy(BLOCK)).alias("block_before")
    )
    within = Window.partitionBy(BLOCK).orderBy(*order)
    earlier = within.rowsBetween(Window.unboundedPreceding, -1)
    previous = F.lag(F.struct("device_id", "last_flowing")).over(within)
    return (
        devices.withColumn("earlier_runs", F.coalesce(F.sum("runs").over(earlier), F.lit(0)))
        .withColumn("previous", previous)
        .join(F.broadcast(blocks), BLOCK)
        .withColumn("previous", F.coalesce("previous", "block_before"))
        .select(
            "device_id",
            F.struct(
                (F.col("start") + F.col("earlier_runs")).alias("runs"),
                F.col("previous.device_id").alias("device_id"),
                F.col("previous.last_flowing").alias("flowing"),
            ).alias("before"),
        )
    )


def find_leaks(days: DataFrame, run: str = "run") -> DataFrame:
    """Runs of more than one day whose smallest flow never reaches zero.

    Takes ``flow_runs`` or, with ``run="consecutive_flow_state"``, its globally numbered form.
    ``leak_length_days`` counts reported days, ``leak_amount_litres`` is the smallest hourly flow of
    the run, and ``leak_active`` says whether the device flows on its latest day, also for its
    earlier leaks. Days are combined to runs first, so the latest state is looked up among a
    device's runs and no join is needed.
    """
    latest_run_first = Window.partitionBy("device_id").orderBy(F.desc("latest"))
    return (
        days.groupBy("device_id", run, "flowing")
        .agg(
            F.min("date").alias("leak_start_date"),
            F.max("date").alias("latest"),
            F.count(F.lit(1)).alias("leak_length_days"),
            F.min("min_flow").alias("leak_amount_litres"),
        )
        .withColumn("leak_active", F.first("flowing").over(latest_run_first))
        .filter((F.col("leak_amount_litres") != 0) & (F.col("leak_length_days") > 1))
        .select(
            "device_id", "leak_start_date", "leak_length_days", "leak_amount_litres", "leak_active"
        )
    )
