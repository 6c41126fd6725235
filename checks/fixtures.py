"""Message, document and device tables derived from the given tables (FIXTURES.md)."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from metertide.functions.time import timestamp_text
from metertide.schemas import DEVICE, FLOW_COLUMNS, MESSAGES

START, END = "2024-01-03", "2024-01-28"
# Two exports that overlap: one ends, the other begins at these instants.
FIRST_EXPORT_END, SECOND_EXPORT_START = "2024-01-19T00:00:00", "2024-01-13T00:00:00"
FIXED_TIME = "2024-01-31 12:00:00"
DOCUMENT_SIZE = 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _message_columns() -> dict[str, Column]:
    user, event = F.col("user_id"), F.col("event_id")
    day = F.dayofmonth("ts")
    base = F.when(
        (user + F.floor(day / 6)) % 3 == 0, 1 + user % 4
    ).otherwise(F.lit(0))
    k = F.get_json_object("props", "$.k").cast("int")

    def flow(number: int) -> Column:
        used = (user % 10 != 9) & ((event + number) % 3 == 0)
        reading = F.least(F.lit(255), base + F.when(used, F.floor("value")).otherwise(F.lit(0)))
        # Some readings are missing, and some devices miss all of them for three days.
        missing = ((event + number) % 41 == 0) | ((user % 30 == 17) & day.between(11, 13))
        return F.when(~missing, reading).cast("bigint")

    flows = {name: flow(number) for number, name in enumerate(FLOW_COLUMNS, start=1)}
    id_text = F.concat(F.lit("D"), user.cast("string"))
    few_readings = (user % 20 == 3) | ((user % 20 == 7) & (event % 5 == 0))
    short_xtime = (user % 20 == 11) | ((user % 20 == 13) & (event % 7 == 0))
    device = (
        F.when(user % 75 == 44, F.lit(None).cast("string"))
        .when((user % 25 == 0) & (event % 2 == 0), F.concat(id_text, F.lit(" ")))
        .when((user % 25 == 6) & (event % 3 == 0), F.concat(F.lit("\t"), id_text))
        .otherwise(id_text)
    )
    return {
        "DeviceID": device,
        "Timestamp": timestamp_text(F.col("ts")),
        "Epoch": F.timestamp_diff(
            "SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts")
        ),
        "rawData": F.col("props"),
        "msgType": F.when(F.col("event_type") == "error", 2).otherwise(1),
        "msgSeq": event % 256,
        "readings": F.when(few_readings, 4).otherwise(8),
        "index": k,
        **flows,
        "xtime": F.when(short_xtime, 1).otherwise(4),
        "MAXFLOW": F.greatest(*flows.values()),
        "MINFLOW": F.least(*flows.values()),
    }


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as messages.

    The timestamp text goes through ``explode``, as Spark would otherwise copy its making into
    every use in a filter; in a real export it is a plain column.
    """
    events = table(spark, sf_dir, "events").select(
        "*", F.explode(F.array(timestamp_text(F.col("ts")))).alias("Timestamp")
    )
    columns = _message_columns() | {"Timestamp": F.col("Timestamp")}
    return events.select(
        [columns[field.name].cast(field.dataType).alias(field.name) for field in MESSAGES]
    )


def decoded_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages as a table of JSON documents."""
    columns = _message_columns()
    inner = ["msgType", "msgSeq", "readings", "index", *FLOW_COLUMNS, "xtime", "MINFLOW", "MAXFLOW"]
    payload = F.to_json(
        F.struct(
            columns["DeviceID"].alias("devicename"),
            columns["Epoch"].alias("timestamp"),
            columns["rawData"].alias("data"),
            F.struct(*[columns[name].alias(name) for name in inner]).alias("decoded_data"),
        ),
        {"ignoreNullFields": "false"},
    )
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), "ts", payload.alias("payload")
    )


def organisation_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as organisations, 50 to a document."""
    key = F.col("c_custkey")
    organisation = F.struct(
        (key % DOCUMENT_SIZE).alias("id"),
        F.array_repeat(F.lit("g"), (F.col("c_nationkey") % 3).cast("int")).alias("groups"),
        F.col("c_name").alias("companyname"),
    )
    return (
        table(spark, sf_dir, "customer")
        .groupBy(F.floor(key / DOCUMENT_SIZE).alias("document"))
        .agg(F.collect_list(organisation).alias("organisations"))
        .select(F.to_json(F.struct("organisations")).alias("doc"))
    )


def devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.col("o_orderkey")
    columns = {
        "id": F.when(order % 1000 != 7, order),
        "devicename": F.concat(F.lit("D"), F.col("o_custkey").cast("string")),
        "databytes": F.floor("o_totalprice") % 256,
        "datatime": F.col("o_orderdate"),
        "devicetype_id": order % 4 + 1,
        "codec_id": F.lit(15),
        "location_id": F.col("o_custkey") % 2 + 1,
    }
    return table(spark, sf_dir, "orders").select(
        [columns[field.name].cast(field.dataType).alias(field.name) for field in DEVICE]
    )
