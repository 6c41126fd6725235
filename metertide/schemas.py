"""The fixed vocabulary: column names, order and types of every table.

Stages never infer a schema; they read with one of these.
"""

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    ByteType,
    DataType,
    DateType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructType,
    TimestampNTZType,
)

TEXT, INT, LONG, TINY = StringType(), IntegerType(), LongType(), ByteType()
REAL, FLAG, DAY, INSTANT = DoubleType(), BooleanType(), DateType(), TimestampNTZType()

FLOW_COLUMNS = [f"FLOW{i}" for i in range(1, 9)]
_FLOWS = dict.fromkeys(FLOW_COLUMNS, LONG)


def _struct(fields: dict[str, DataType]) -> StructType:
    schema = StructType()
    for name, kind in fields.items():
        schema = schema.add(name, kind)
    return schema


# Column names and order of a message export.
MESSAGES = _struct(
    {
        "DeviceID": TEXT,
        "Timestamp": TEXT,
        "Epoch": LONG,
        "rawData": TEXT,
        "msgType": INT,
        "msgSeq": LONG,
        "readings": INT,
        "index": INT,
        **_FLOWS,
        "xtime": INT,
        "MAXFLOW": LONG,
        "MINFLOW": LONG,
    }
)

# The JSON document of a decoded message.
DECODED_PAYLOAD = _struct(
    {
        "devicename": TEXT,
        "timestamp": LONG,
        "data": TEXT,
        "decoded_data": _struct(
            {
                "msgType": INT,
                "msgSeq": LONG,
                "readings": INT,
                "index": INT,
                **_FLOWS,
                "xtime": INT,
                "MINFLOW": LONG,
                "MAXFLOW": LONG,
            }
        ),
    }
)

# The JSON document that lists organisations.
ORGANISATIONS = _struct(
    {
        "organisations": ArrayType(
            _struct({"id": LONG, "groups": ArrayType(TEXT), "companyname": TEXT})
        )
    }
)

# The device table.
DEVICE = _struct(
    {
        "id": LONG,
        "devicename": TEXT,
        "databytes": INT,
        "datatime": INSTANT,
        "devicetype_id": INT,
        "codec_id": INT,
        "location_id": INT,
    }
)

# The tables that the operators return.
CLEAN = _struct({"device_id": TEXT, "timestamp": INSTANT, **_FLOWS})
FLOWS = _struct({"device_id": TEXT, "date": DAY, "hour": TINY, "flow": LONG})
DAY_FLOWS = _struct(
    {"device_id": TEXT, "date": DAY, "total_flow": LONG, "min_flow": LONG, "clipped": FLAG}
)
CONSECUTIVE_FLOW = _struct(
    {
        **{field.name: field.dataType for field in DAY_FLOWS},
        "flowing": FLAG,
        "prev_flowing": FLAG,
        "prev_device_id": TEXT,
        "consecutive_flow_state": LONG,
    }
)
LEAKAGE = _struct(
    {
        "device_id": TEXT,
        "leak_start_date": DAY,
        "leak_length_days": LONG,
        "leak_amount_litres": LONG,
        "leak_active": FLAG,
    }
)
USAGE = _struct({"device_id": TEXT, "avg_daily_flow": REAL, "clipped": FLAG})
DROPPED_DEVICES = _struct(
    {
        "DeviceID": TEXT,
        "has_8_readings": FLAG,
        "has_no_non_8_readings": FLAG,
        "has_4_xtime": FLAG,
        "has_no_non_4_xtime": FLAG,
        "dropped": FLAG,
    }
)

# What is kept of a date and of a month between reports.
DAY_PARTS = _struct({"device_id": TEXT, "date": DAY, "total": LONG, "least": LONG, "most": LONG})
DEVICE_PARTS = _struct(
    {
        "DeviceID": TEXT,
        "most_readings": INT,
        "least_readings": INT,
        "most_xtime": INT,
        "least_xtime": INT,
    }
)
STRETCH_DAYS = _struct(
    {
        **{field.name: field.dataType for field in DAY_FLOWS},
        "flowing": FLAG,
        "prev_flowing": FLAG,
        "run": LONG,
        "position": INT,
    }
)
STRETCH_RUNS = _struct(
    {
        "device_id": TEXT,
        "run": LONG,
        "flowing": FLAG,
        "start": DAY,
        "latest": DAY,
        "days": LONG,
        "amount": LONG,
        "runs": LONG,
    }
)
