"""The same queries as SQL over the given tables."""

from checks.fixtures import DOCUMENT_SIZE, END, FIXED_TIME, START

_FLOW_NAMES = [f"FLOW{i}" for i in range(1, 9)]
_FLOW_LIST = ", ".join(_FLOW_NAMES)


def _flow(number: int) -> str:
    return (
        f"CASE WHEN (event_id + {number}) % 41 = 0 OR (user_id % 30 = 17 AND day(ts) BETWEEN 11 AND 13) THEN NULL "
        f"ELSE least(255, base + CASE WHEN user_id % 10 <> 9 AND (event_id + {number}) % 3 = 0 "
        f"THEN CAST(floor(value) AS BIGINT) ELSE 0 END) END::BIGINT AS FLOW{number}"
    )


_MESSAGES = f"""
based AS (
  SELECT *, CASE WHEN (user_id + day(ts) // 6) % 3 = 0 THEN 1 + user_id % 4 ELSE 0 END AS base
  FROM events
),
flowed AS (SELECT *, {", ".join(_flow(i) for i in range(1, 9))} FROM based),
messages AS (
  SELECT
    CASE WHEN user_id % 75 = 44 THEN NULL
      WHEN user_id % 25 = 0 AND event_id % 2 = 0 THEN 'D' || user_id || ' '
      WHEN user_id % 25 = 6 AND event_id % 3 = 0 THEN chr(9) || 'D' || user_id
      ELSE 'D' || user_id END AS "DeviceID",
    strftime(ts, '%Y-%m-%dT%H:%M:%S') AS "Timestamp",
    CAST(floor(epoch(ts)) AS BIGINT) AS "Epoch",
    props AS "rawData",
    CAST(CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS INTEGER) AS "msgType",
    CAST(event_id % 256 AS BIGINT) AS "msgSeq",
    CAST(CASE WHEN user_id % 20 = 3 OR (user_id % 20 = 7 AND event_id % 5 = 0) THEN 4 ELSE 8 END AS INTEGER)
      AS readings,
    CAST(json_extract(props, '$.k') AS INTEGER) AS "index",
    {_FLOW_LIST},
    CAST(CASE WHEN user_id % 20 = 11 OR (user_id % 20 = 13 AND event_id % 7 = 0) THEN 1 ELSE 4 END AS INTEGER)
      AS xtime,
    greatest({_FLOW_LIST}) AS "MAXFLOW",
    least({_FLOW_LIST}) AS "MINFLOW"
  FROM flowed
)"""

_FILTERED = f"""{_MESSAGES},
filtered AS (
  SELECT DISTINCT * FROM messages
  WHERE CAST("Timestamp" AS TIMESTAMP) >= TIMESTAMP '{START} 00:00:00'
    AND CAST("Timestamp" AS TIMESTAMP) <= TIMESTAMP '{END} 00:00:00'
)"""

_CLEAN = f"""{_FILTERED},
clean AS (
  SELECT trim("DeviceID", ' ' || chr(9)) AS device_id, strptime("Timestamp", '%Y-%m-%dT%H:%M:%S') AS "timestamp", {_FLOW_LIST}
  FROM filtered WHERE readings = 8 AND "msgType" = 1 AND xtime = 4
)"""


def _reading(number: int) -> str:
    return (
        'SELECT device_id, "timestamp" - INTERVAL 1 HOUR * '
        f'({8 - number} + CASE WHEN minute("timestamp") < 30 THEN 1 ELSE 0 END) AS adj_timestamp, '
        f"FLOW{number} AS flow FROM clean"
    )


_FLOWS = f"""{_CLEAN},
readings AS ({" UNION ALL ".join(_reading(i) for i in range(1, 9))}),
flows AS (
  SELECT device_id, CAST(adj_timestamp AS DATE) AS date, CAST(hour(adj_timestamp) AS TINYINT) AS hour, flow FROM readings
)"""

_DAYS = f"""{_FLOWS},
day_flows AS (
  SELECT device_id, date, CAST(sum(flow) AS BIGINT) AS total_flow, min(flow) AS min_flow,
    max(flow) = 255 AS clipped
  FROM flows GROUP BY device_id, date
)"""

# One window over the whole table, as opposed to the two-level numbering of the Spark query.
_STATES = f"""{_DAYS},
flagged AS (SELECT *, min_flow <> 0 AS flowing FROM day_flows),
shifted AS (
  SELECT *,
    lag(flowing) OVER (ORDER BY device_id DESC, date DESC) AS prev_flowing,
    lag(device_id) OVER (ORDER BY device_id DESC, date DESC) AS prev_device_id
  FROM flagged
),
states AS (
  SELECT *,
    CAST(sum(CASE WHEN flowing = prev_flowing AND device_id IS NOT DISTINCT FROM prev_device_id
        THEN 0 ELSE 1 END)
      OVER (ORDER BY device_id DESC, date DESC ROWS UNBOUNDED PRECEDING) AS BIGINT)
      AS consecutive_flow_state
  FROM shifted
)"""

_LEAKS = f"""{_STATES},
runs AS (
  SELECT any_value(device_id) AS device_id, min(date) AS leak_start_date, count(*) AS leak_length_days,
    min(min_flow) AS leak_amount_litres
  FROM states GROUP BY consecutive_flow_state
),
latest AS (
  SELECT DISTINCT device_id, first_value(flowing) OVER (PARTITION BY device_id ORDER BY date DESC) AS leak_active
  FROM states
),
leaks AS (
  SELECT runs.*, leak_active FROM runs JOIN latest ON runs.device_id IS NOT DISTINCT FROM latest.device_id
  WHERE leak_amount_litres <> 0 AND leak_length_days > 1
)"""

_LEAK_STATS = f"""{_LEAKS},
leak_stats AS (
  SELECT 'total_leaks' AS leakage_stat, CAST(count(*) AS DOUBLE) AS value FROM leaks
  UNION ALL SELECT 'active_leaks', CAST(count(*) FILTER (WHERE leak_active) AS DOUBLE) FROM leaks
  UNION ALL SELECT 'avg_leak_amount_litres', avg(leak_amount_litres) FROM leaks
  UNION ALL SELECT 'max_leak_amount_litres', CAST(max(leak_amount_litres) AS DOUBLE) FROM leaks
  UNION ALL SELECT 'avg_leak_length_days', avg(leak_length_days) FROM leaks
  UNION ALL SELECT 'max_leak_length_days', CAST(max(leak_length_days) AS DOUBLE) FROM leaks
)"""

_USAGE_ONLY = """
usage AS (
  SELECT device_id, avg(total_flow) AS avg_daily_flow, bool_or(clipped) AS clipped
  FROM day_flows GROUP BY device_id HAVING avg(total_flow) > 10
)"""
_USAGE = f"{_DAYS},{_USAGE_ONLY}"

_USAGE_STATS_ONLY = """
usage_stats AS (
  SELECT 'clipped_devices' AS usage_stat, CAST(count(*) FILTER (WHERE clipped) AS DOUBLE) AS value FROM usage
  UNION ALL SELECT 'avg_daily_flow', avg(avg_daily_flow) FROM usage
  UNION ALL SELECT 'max_daily_flow', max(avg_daily_flow) FROM usage
  UNION ALL SELECT 'min_daily_flow', min(avg_daily_flow) FROM usage
  UNION ALL SELECT 'median_daily_flow', median(avg_daily_flow) FROM usage
)"""

_DROPPED_ONLY = """
flags AS (
  SELECT "DeviceID", max(readings) = 8 AS has_8_readings, min(readings) = 8 AS has_no_non_8_readings,
    max(xtime) = 4 AS has_4_xtime, min(xtime) = 4 AS has_no_non_4_xtime
  FROM filtered GROUP BY "DeviceID"
),
dropped_devices AS (
  SELECT *, NOT has_8_readings OR NOT has_4_xtime AS dropped FROM flags
  WHERE NOT (has_8_readings AND has_no_non_8_readings AND has_4_xtime AND has_no_non_4_xtime)
)"""

_INITIAL_ONLY = """
initial AS (SELECT count(*) AS num_devices FROM (SELECT DISTINCT "DeviceID" FROM filtered))"""

_DROPPED_STATS_ONLY = f"""{_DROPPED_ONLY},{_INITIAL_ONLY},
counted AS (
  SELECT (SELECT num_devices FROM initial) AS initial_devices,
    (SELECT count(*) FROM usage) AS included_devices,
    (SELECT count(*) FROM dropped_devices WHERE dropped) AS num_dropped,
    (SELECT count(*) FROM dropped_devices WHERE NOT dropped) AS num_reduced
),
dropped_stats AS (
  SELECT 'initial_devices' AS dropped_stat, initial_devices AS value FROM counted
  UNION ALL SELECT 'included_devices', included_devices FROM counted
  UNION ALL SELECT 'excluded_devices', initial_devices - included_devices FROM counted
  UNION ALL SELECT 'num_devices_dropped', num_dropped FROM counted
  UNION ALL SELECT 'num_devices_reduced', num_reduced FROM counted
  UNION ALL SELECT 'very_low_count_excluded_devices', initial_devices - included_devices - num_dropped
    FROM counted
)"""

_DEVICES = """
device AS (
  SELECT CASE WHEN o_orderkey % 1000 <> 7 THEN o_orderkey END AS id,
    'D' || o_custkey AS devicename,
    CAST(CAST(floor(o_totalprice) AS BIGINT) % 256 AS INTEGER) AS databytes,
    CAST(o_orderdate AS TIMESTAMP) AS datatime,
    CAST(o_orderkey % 4 + 1 AS INTEGER) AS devicetype_id,
    15 AS codec_id,
    CAST(o_custkey % 2 + 1 AS INTEGER) AS location_id
  FROM orders
)"""

# Each report's table, and a whole number per row whose sum shows its contents.
_REPORTS = {
    "filtered_messages": ("filtered", " + ".join(f"coalesce({name}, 0)" for name in _FLOW_NAMES)),
    "initial_device_count": ("initial", "num_devices"),
    "day_flows": ("day_flows", "coalesce(total_flow, 0) + 1000 * coalesce(min_flow, 0) + CAST(coalesce(clipped, false) AS INT)"),
    "consecutive_flow": ("states", "consecutive_flow_state + coalesce(total_flow, 0)"),
    "leakage": ("leaks", "leak_amount_litres + 1000 * leak_length_days + CAST(coalesce(leak_active, false) AS INT)"),
    "leakage_stats": ("leak_stats", "CAST(round(1000 * value) AS BIGINT)"),
    "usage": ("usage", "CAST(round(1000 * avg_daily_flow) AS BIGINT) + CAST(coalesce(clipped, false) AS INT)"),
    "usage_stats": ("usage_stats", "CAST(round(1000 * value) AS BIGINT)"),
    "dropped_devices": (
        "dropped_devices",
        "CAST(has_8_readings AS INT) + 2 * CAST(has_no_non_8_readings AS INT) + 4 * CAST(has_4_xtime AS INT)"
        " + 8 * CAST(has_no_non_4_xtime AS INT) + 16 * CAST(dropped AS INT)",
    ),
    "dropped_devices_stats": ("dropped_stats", "value"),
}
_COUNTS = " UNION ALL ".join(
    f"SELECT '{report}' AS report, count(*) AS row_count, CAST(sum({content}) AS BIGINT) AS content FROM {name}"
    for report, (name, content) in _REPORTS.items()
)
REPORT_CONTENTS = {report: content for report, (_, content) in _REPORTS.items()}

_DAY_FLOWS = f"WITH {_DAYS} SELECT * FROM day_flows"

ORACLE: dict[str, str] = {
    "messages_scan": f"WITH {_MESSAGES} SELECT * FROM messages",
    "messages_union_distinct": f"WITH {_MESSAGES} SELECT DISTINCT * FROM messages",
    "decoded_json_flatten": f"WITH {_MESSAGES} SELECT * FROM messages",
    "organisations_explode": f"""SELECT c_name AS companyname FROM customer
        WHERE c_custkey % {DOCUMENT_SIZE} <> 0 AND c_nationkey % 3 > 0""",
    "filter_dates": f"WITH {_FILTERED} SELECT * FROM filtered",
    "initial_device_count": f"WITH {_FILTERED}, {_INITIAL_ONLY} SELECT * FROM initial",
    "clean_messages": f"WITH {_CLEAN} SELECT * FROM clean",
    "flow_rows": f"WITH {_FLOWS} SELECT * FROM flows",
    "day_flows": _DAY_FLOWS,
    "day_flows_of_messages": _DAY_FLOWS,
    "consecutive_flow_state": f"""WITH {_STATES}
        SELECT device_id, date, total_flow, min_flow, clipped, flowing, prev_flowing, prev_device_id,
          consecutive_flow_state FROM states""",
    "leaks": f"""WITH {_LEAKS} SELECT device_id, leak_start_date, leak_length_days, leak_amount_litres,
        leak_active FROM leaks""",
    "leak_stats": f"WITH {_LEAK_STATS} SELECT leakage_stat, round(value, 6) AS value FROM leak_stats",
    "usage": f"""WITH {_USAGE} SELECT device_id, round(avg_daily_flow, 6) AS avg_daily_flow, clipped
        FROM usage""",
    "usage_stats": f"""WITH {_USAGE}, {_USAGE_STATS_ONLY}
        SELECT usage_stat, round(value, 6) AS value FROM usage_stats""",
    "dropped_devices": f"WITH {_FILTERED}, {_DROPPED_ONLY} SELECT * FROM dropped_devices",
    "dropped_device_stats": f"WITH {_USAGE}, {_DROPPED_STATS_ONLY} SELECT * FROM dropped_stats",
    "reports_all": f"""WITH {_LEAK_STATS}, {_USAGE_ONLY}, {_USAGE_STATS_ONLY}, {_DROPPED_STATS_ONLY}
        {_COUNTS}""",
    "device_select": f"WITH {_DEVICES} SELECT devicename, databytes, datatime, devicetype_id FROM device",
    "device_update": f"""WITH {_DEVICES} SELECT * REPLACE
        (CASE WHEN id = 5 THEN 'edited' ELSE devicename END AS devicename) FROM device""",
    "device_delete": f"WITH {_DEVICES} SELECT * FROM device WHERE id IS DISTINCT FROM 6",
    "device_append": f"""WITH {_DEVICES} SELECT * FROM device
        UNION ALL VALUES (5, '9982', 12, TIMESTAMP '{FIXED_TIME}', 1, 15, 1),
          (6, '1232', 14, TIMESTAMP '{FIXED_TIME}', 1, 15, 2)""",
    "indexed_edit": """WITH
        indexed AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS "index", c_name, c_mktsegment
          FROM customer)
        SELECT "index", c_name AS col1,
          CASE WHEN s_suppkey IS NOT NULL THEN s_name ELSE c_mktsegment END AS col2
        FROM indexed LEFT JOIN supplier ON s_suppkey = "index"
        UNION ALL SELECT (SELECT count(*) FROM customer), '1-4', '2-4'
        UNION ALL SELECT (SELECT count(*) FROM customer) + 1, '1-5', '2-5'""",
    "repeated_header_load": f"WITH {_DEVICES} SELECT * FROM device",
    "run_dates": """SELECT DISTINCT CAST(CAST(ts AS DATE) + 1 AS DATE) AS run_day,
        strftime(ts, '%Y%m%d000000') AS date_from,
        strftime(CAST(ts AS DATE) + 1, '%Y%m%d000000') AS date_to,
        'meters_' || strftime(ts, '%Y-%m-%d') || '_' || strftime(CAST(ts AS DATE) + 1, '%Y-%m-%d') AS run
        FROM events""",
}

# The same results by other ways.
ORACLE["stretch_flow_state"] = ORACLE["consecutive_flow_state"]
ORACLE["stretch_leaks"] = ORACLE["leaks"]
ORACLE["history_reports"] = ORACLE["reports_all"]
ORACLE["bucketed_distinct"] = ORACLE["filter_dates"]
