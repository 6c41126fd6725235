"""From messages to hourly readings and to device-days."""

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, functions as F

from metertide.functions.time import READINGS_PER_MESSAGE, last_reading_hour
from metertide.schemas import FLOW_COLUMNS

# Fixed value: an 8-bit counter that ran full.
CLIPPED_FLOW = 255


def _by_message_day(clean: DataFrame, *keys: str) -> DataFrame:
    return clean.select(
        *keys,
        "device_id",
        F.to_date("timestamp").alias("day"),
        last_reading_hour(F.col("timestamp")).alias("last_hour"),
        *FLOW_COLUMNS,
    )


def unpack_flows(clean: DataFrame) -> DataFrame:
    """One row per reading: ``device_id, date, hour, flow``.

    One pass, no shuffle. Readings lie whole hours apart, so date and hour follow from whole
    numbers; the time of each reading never has to be computed. Null readings stay, and
    overlapping messages are not reconciled.
    """
    hour = F.col("last_hour") - (READINGS_PER_MESSAGE - 1) + F.col("pos")
    return (
        _by_message_day(clean)
        .select(
            "device_id",
            "day",
            "last_hour",
            F.posexplode(F.array(*FLOW_COLUMNS)).alias("pos", "flow"),
        )
        .select(
            "device_id",
            F.when(hour < 0, F.date_sub("day", 1)).otherwise(F.col("day")).alias("date"),
            F.pmod(hour, F.lit(24)).cast("tinyint").alias("hour"),
            "flow",
        )
    )


def daily_flows(flows: DataFrame) -> DataFrame:
    """Total, smallest and clipped flow per device and date.

    Readings are combined before the shuffle, so one busy device costs no more than its days.
    """
    return flows.groupBy("device_id", "date").agg(
        F.sum("flow").alias("total_flow"),
        F.min("flow").alias("min_flow"),
        (F.max("flow") == CLIPPED_FLOW).alias("clipped"),
    )


def daily_flows_of_messages(clean: DataFrame) -> DataFrame:
    """The same table as ``daily_flows(unpack_flows(clean))``, with less work per message."""
    return merge_day_parts(_parts_of_messages(clean))


def day_parts(clean: DataFrame, *keys: str) -> DataFrame:
    """Partial device-days: ``device_id``, ``date``, ``total``, ``least``, ``most``, apart for each value of further
    ``keys``. Those of different messages are put together by ``merge_day_parts``."""
    return (
        _parts_of_messages(clean, *keys)
        .groupBy(*keys, "device_id", "date")
        .agg(F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"))
    )


def merge_day_parts(parts: DataFrame) -> DataFrame:
    return parts.groupBy("device_id", "date").agg(
        F.sum("total").alias("total_flow"),
        F.min("least").alias("min_flow"),
        (F.max("most") == CLIPPED_FLOW).alias("clipped"),
    )


def _parts_of_messages(clean: DataFrame, *keys: str) -> DataFrame:
    """The eight readings of a message touch at most two dates. Each message gives one partial row
    per date it touches, instead of eight, to the aggregation.
    """
    message = _by_message_day(clean, *keys).withColumn(
        "before", F.greatest(F.lit(0), F.lit(READINGS_PER_MESSAGE - 1) - F.col("last_hour"))
    )

    def part(date: Column, touched: Column, belongs) -> Column:
        readings = [
            F.when(belongs(F.lit(number)), F.col(name))
            for number, name in enumerate(FLOW_COLUMNS, start=1)
        ]
        least = F.least(*readings)
        total = reduce(add, [F.coalesce(reading, F.lit(0)) for reading in readings])
        return F.struct(
            touched.alias("touched"),
            date.alias("date"),
            F.when(least.isNotNull(), total).alias("total"),
            least.alias("least"),
            F.greatest(*readings).alias("most"),
        )

    before, day = F.col("before"), F.col("day")
    return message.select(
        *keys,
        "device_id",
        F.inline(
            F.array(
                part(F.date_sub(day, 1), before > 0, lambda number: number <= before),
                part(day, before < READINGS_PER_MESSAGE, lambda number: number > before),
            )
        ),
    ).filter("touched")
