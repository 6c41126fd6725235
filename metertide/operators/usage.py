from pyspark.sql import DataFrame, functions as F

# Fixed value: devices must use more than this per day.
LEAST_DAILY_FLOW = 10


def device_usage(day_flows: DataFrame) -> DataFrame:
    """Average daily flow per device, above 10 only, and whether any of its days was clipped."""
    return (
        day_flows.groupBy("device_id")
        .agg(F.avg("total_flow").alias("avg_daily_flow"), F.bool_or("clipped").alias("clipped"))
        .filter(F.col("avg_daily_flow") > LEAST_DAILY_FLOW)
    )
