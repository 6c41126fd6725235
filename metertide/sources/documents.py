"""JSON documents: decoded messages and lists of organisations."""

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from metertide.functions.strict import read_every_column
from metertide.functions.time import timestamp_text
from metertide.schemas import DECODED_PAYLOAD, MESSAGES, ORGANISATIONS


def flatten_decoded(decoded: DataFrame, on_error: str = "raise") -> DataFrame:
    """``ts`` and JSON ``payload`` to the 19 message columns.

    A key that is missing from a document raises, while a JSON null is a null; malformed documents
    raise too. With ``on_error="null"`` all of these become null.
    """
    mode = {"mode": "FAILFAST"} if on_error == "raise" else {"mode": "PERMISSIVE"}
    parsed = decoded.select(
        "ts", "payload", F.from_json("payload", DECODED_PAYLOAD, mode).alias("document")
    )
    if on_error == "raise":
        # By way of a generator: a filter would be pushed below the parsing, once per field.
        parsed = parsed.select("ts", F.explode(F.array(_with_all_keys())).alias("document"))
    document = F.col("document")
    columns = {
        "DeviceID": document["devicename"],
        "Timestamp": timestamp_text(F.col("ts")),
        "Epoch": document["timestamp"],
        "rawData": document["data"],
    }
    messages = parsed.select(
        [
            columns.get(name, document["decoded_data"][name]).alias(name)
            for name in MESSAGES.fieldNames()
        ]
    )
    return read_every_column(messages) if on_error == "raise" else messages


def _with_all_keys() -> Column:
    """The document, or an error. Looks for missing keys only where some field came out null."""
    document, decoded = F.col("document"), F.col("document.decoded_data")
    outer = DECODED_PAYLOAD.fieldNames()
    inner = DECODED_PAYLOAD["decoded_data"].dataType.fieldNames()
    fields = [document[name] for name in outer] + [decoded[name] for name in inner]
    some_null = reduce(or_, [field.isNull() for field in fields])

    def missing(required: list[str], json: Column) -> Column:
        no_keys = F.array().cast("array<string>")
        return F.array_except(
            F.array(*[F.lit(name) for name in required]),
            F.coalesce(F.json_object_keys(json), no_keys),
        )

    absent = F.concat(
        missing(outer, F.col("payload")),
        missing(inner, F.get_json_object("payload", "$.decoded_data")),
    )
    return F.when(
        some_null & (F.size(absent) > 0),
        F.raise_error(
            F.concat(F.lit("missing keys in decoded message: "), F.array_join(absent, ", "))
        ),
    ).otherwise(document)


def organisation_names(documents: DataFrame, default_id: int = 0) -> DataFrame:
    """Names of the organisations in JSON ``doc``s: one row each, default and empty ones left out.

    ``default_id`` is the id of the built-in organisation, which differs between platforms.
    """
    return (
        documents.select(F.from_json("doc", ORGANISATIONS, {"mode": "FAILFAST"}).alias("document"))
        .select(F.inline("document.organisations"))
        .filter(~F.col("id").eqNullSafe(F.lit(default_id)) & (F.size("groups") > 0))
        .select("companyname")
    )
