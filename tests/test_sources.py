"""Files, documents and database options."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from metertide.schemas import DECODED_PAYLOAD, MESSAGES
from metertide.operators.messages import dropped_devices, filter_messages, initial_device_count
from metertide.plans.reports import collect_from_database, load_table_from_files
from metertide.sinks.files import write_csv
from metertide.sources.documents import flatten_decoded, organisation_names
from metertide.sources.files import read_csv, read_messages, read_with_repeated_headers
from metertide.sources.jdbc import (
    Connection,
    day_predicates,
    histogram_sql,
    read_query,
    read_table,
    read_table_by_range,
    slice_cuts,
    slice_predicates,
)
from metertide.sinks.jdbc import append_to_table
from tests.builders import message, messages

HEADER = ",".join(MESSAGES.fieldNames())
LINE = "{device},2024-01-05T10:00:00,1,raw,1,2,8,0,1,2,3,4,5,6,7,8,4,8,1"


def rows_of(df):
    return sorted((tuple(row) for row in df.collect()), key=str)


def test_csv_round_trip_keeps_spaces_quotes_and_nulls(spark, tmp_path):
    rows = [message(device) for device in ("D1", "D1 ", " D1", 'say "hi", you', "a\\", None)]
    df = messages(spark, *rows, message("D2", flows=[None] * 8)).repartition(3)
    write_csv(df, str(tmp_path / "out"))
    back = read_messages(spark, str(tmp_path / "out"))
    assert back.schema == MESSAGES and rows_of(back) == rows_of(df)


def test_many_files_are_one_table_and_headers_are_positional(spark, tmp_path):
    (tmp_path / "a.csv").write_text(f"{HEADER}\n{LINE.format(device='D1')}\n")
    other_header = ",".join(f"c{n}" for n in range(19))
    (tmp_path / "b.csv").write_text(f"{other_header}\n{LINE.format(device='D2')}\n")
    assert {row.DeviceID for row in read_messages(spark, str(tmp_path)).collect()} == {"D1", "D2"}
    paths = [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]
    assert read_messages(spark, paths).count() == 2
    with pytest.raises(Exception, match="header|CSV"):
        read_csv(spark, paths, MESSAGES, check_header=True).collect()


def test_malformed_field_raises_or_becomes_null(spark, tmp_path):
    line = LINE.format(device="D1").replace("raw,1,", "raw,one,")
    (tmp_path / "a.csv").write_text(f"{HEADER}\n{line}\n")
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ"):
        read_messages(spark, str(tmp_path)).collect()
    row = read_messages(spark, str(tmp_path), on_error="null").first()
    assert row.msgType is None and row.DeviceID == "D1"


@pytest.mark.parametrize("on_error", ["raise", "null"])
def test_strictness_does_not_depend_on_what_is_asked(spark, tmp_path, on_error):
    bad = LINE.format(device="D2").replace(",3,4,5", ",3,oops,5")
    (tmp_path / "a.csv").write_text(f"{HEADER}\n{LINE.format(device='D1')}\n{bad}\n")
    rows = read_messages(spark, str(tmp_path), on_error)
    questions = [
        lambda: rows.count(),
        lambda: rows.distinct().count(),
        lambda: initial_device_count(rows).first().num_devices,
        lambda: 2 - dropped_devices(rows).count(),
        lambda: filter_messages(rows, "2024-01-01", "2024-01-31", on_error).count(),
        lambda: rows.select("DeviceID").distinct().count(),
    ]
    for ask in questions:
        if on_error == "null":
            assert ask() == 2
        else:
            with pytest.raises(Exception, match="MALFORMED|FAILED_READ"):
                ask()


def test_documents_are_strict_whatever_is_asked(spark):
    df = decoded(spark, document(), document(FLOW1="many"))
    for ask in (lambda m: m.count(), initial_device_count, lambda m: m.select("DeviceID")):
        with pytest.raises(Exception):
            found = ask(flatten_decoded(df))
            found if isinstance(found, int) else found.collect()
        found = ask(flatten_decoded(df, "null"))
        assert found == 2 if isinstance(found, int) else found.count() in (1, 2)


def test_headers_in_another_order_raise(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,a,b\n1,x,y\n")
    (tmp_path / "b.csv").write_text("id,b,a\n2,y,x\n")
    schema = spark.createDataFrame([], "id bigint, a string, b string").schema
    with pytest.raises(Exception, match="header|CSV"):
        read_with_repeated_headers(spark, str(tmp_path), schema).collect()
    assert read_with_repeated_headers(spark, str(tmp_path / "a.csv"), schema).first().b == "y"


def test_malformed_rows_between_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,a\n1,x\nid,a\ntwo,y\n")
    schema = spark.createDataFrame([], "id bigint, a string").schema
    strict = read_with_repeated_headers(spark, str(tmp_path), schema)
    for ask in (strict.count, strict.select("a").collect):
        with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
            ask()
    lenient = read_with_repeated_headers(spark, str(tmp_path), schema, "null")
    assert rows_of(lenient) == [(1, "x"), (None, "y")]


def test_repeated_headers_are_skipped(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name,id\n"x, y",1\nname,id\nname,2\n,3\nname,id\n')
    (tmp_path / "b.csv").write_text("name,id\nz,4\n")
    schema = spark.createDataFrame([], "id bigint, name string").schema
    df = read_with_repeated_headers(spark, str(tmp_path), schema)
    assert df.schema == schema
    assert rows_of(df) == [(1, "x, y"), (2, "name"), (3, None), (4, "z")]


def document(**changes):
    inner = {name: n for n, name in enumerate(DECODED_PAYLOAD["decoded_data"].dataType.fieldNames())}
    outer = {"devicename": "D1", "timestamp": 7, "data": "raw", "decoded_data": inner}
    for name, value in changes.items():
        place = inner if name in inner else outer
        if value is KeyError:
            del place[name]
        else:
            place[name] = value
    return json.dumps(outer)


def decoded(spark, *payloads):
    return spark.createDataFrame([(payload,) for payload in payloads], "payload string").select(
        F.lit("2024-01-05 10:00:00.25").cast("timestamp_ntz").alias("ts"), "payload"
    )


def test_document_becomes_a_message(spark):
    df = flatten_decoded(decoded(spark, document(extra=1, xtime=None, devicename='D"1 ')))
    assert df.schema == MESSAGES
    row = df.first().asDict()
    assert (row["DeviceID"], row["Timestamp"], row["Epoch"]) == ('D"1 ', "2024-01-05T10:00:00", 7)
    assert (row["FLOW1"], row["MINFLOW"], row["MAXFLOW"], row["xtime"]) == (4, 13, 14, None)


@pytest.mark.parametrize("name", ["devicename", "data", "decoded_data", "FLOW3", "MAXFLOW"])
def test_missing_key_raises_or_becomes_null(spark, name):
    df = decoded(spark, document(**{name: KeyError}))
    with pytest.raises(Exception, match=f"missing keys in decoded message: .*{name}"):
        flatten_decoded(df).collect()
    assert flatten_decoded(df, "null").count() == 1


def test_missing_key_is_found_beside_a_json_null(spark):
    with pytest.raises(Exception, match="missing keys in decoded message: FLOW3"):
        flatten_decoded(decoded(spark, document(FLOW2=None, FLOW3=KeyError))).collect()


@pytest.mark.parametrize("payload", [None, "", "{", '{"devicename": "D1"}', document(FLOW1="many")])
def test_malformed_document_raises_or_becomes_null(spark, payload):
    with pytest.raises(Exception):
        flatten_decoded(decoded(spark, payload)).collect()
    assert flatten_decoded(decoded(spark, payload), "null").first().FLOW1 is None


def test_organisations(spark):
    organisations = [
        {"id": 0, "groups": [1], "companyname": "default"},
        {"id": 1, "groups": [{"id": 3}], "companyname": "Two Words"},
        {"id": 2, "groups": [], "companyname": "empty"},
        {"id": 3, "groups": None, "companyname": "null"},
        {"id": 4, "companyname": "absent"},
        {"id": None, "groups": ["g"], "companyname": "no id"},
    ]
    df = spark.createDataFrame(
        [(json.dumps({"organisations": organisations}),), ('{"organisations": []}',)], "doc string"
    )
    assert rows_of(organisation_names(df)) == [("Two Words",), ("no id",)]
    assert rows_of(organisation_names(df, default_id=1)) == [("default",), ("no id",)]


class Recorder:
    """Stands for a reader or writer and notes the calls; no database is opened."""

    def __init__(self):
        self.calls = []

    def __getattr__(self, name):
        def call(*args, **kwargs):
            self.calls.append((name, args, kwargs))
            return self

        return call


class Session:
    def __init__(self):
        self.read = Recorder()


CONNECTION = Connection("jdbc:x://host/db", "reader", "hidden", {"fetchsize": "5"})


def test_connection():
    postgres = Connection.postgres("host", "db", "reader", "hidden")
    assert postgres.url == "jdbc:postgresql://host:5432/db"
    assert postgres.driver_properties()["driver"] == "org.postgresql.Driver"
    assert "hidden" not in repr(postgres)
    assert Connection("jdbc:x://host/db").driver_properties() == {}


def test_query_options():
    session = Session()
    read_query(session, CONNECTION, "SELECT 1")
    assert session.read.calls == [
        ("format", ("jdbc",), {}),
        (
            "options",
            (),
            {"url": CONNECTION.url, "query": "SELECT 1", "user": "reader", "password": "hidden", "fetchsize": "5"},
        ),
        ("load", (), {}),
    ]


def test_table_options():
    session = Session()
    properties = CONNECTION.driver_properties()
    read_table(session, CONNECTION, "device", ["id < 5", "id >= 5"])
    read_table_by_range(session, CONNECTION, "device", "id", 0, 100, 4)
    assert [call[2] for call in session.read.calls] == [
        {"predicates": ["id < 5", "id >= 5"], "properties": properties},
        {"column": "id", "lowerBound": 0, "upperBound": 100, "numPartitions": 4, "properties": properties},
    ]


def test_day_predicates_cover_the_period_once(spark):
    predicates = day_predicates("ts", "2024-02-28", "2024-03-01")
    assert len(predicates) == 3
    df = spark.sql(
        "SELECT explode(sequence(TIMESTAMP_NTZ'2024-02-27', TIMESTAMP_NTZ'2024-03-02', INTERVAL '6' HOUR)) AS ts"
    )
    hits = df.select(*[F.expr(p).cast("int").alias(f"p{n}") for n, p in enumerate(predicates)], "ts")
    total = hits.select("ts", (F.col("p0") + F.col("p1") + F.col("p2")).alias("hits"))
    inside = "ts BETWEEN TIMESTAMP_NTZ'2024-02-28' AND TIMESTAMP_NTZ'2024-03-01'"
    assert total.filter(f"hits <> CAST({inside} AS INT)").count() == 0


def test_histogram_sql_counts_the_rows_of_the_period():
    import duckdb

    database = duckdb.connect()
    database.execute(
        "CREATE TABLE t AS SELECT TIMESTAMP '2024-01-04 23:59:00' + INTERVAL 1 SECOND * s AS ts"
        " FROM range(0, 87000, 7) AS r(s)"
    )
    sql = histogram_sql("t", "ts", "2024-01-05", "2024-01-06", bins=24)
    found = dict(database.execute(sql).fetchall())
    hours = dict(
        database.execute(
            "SELECT hour(ts), COUNT(*) FROM t WHERE CAST(ts AS DATE) = DATE '2024-01-05' GROUP BY 1"
        ).fetchall()
    )
    assert found == hours and len(found) == 24
    assert "FROM t TABLESAMPLE SYSTEM (1) WHERE" in histogram_sql(
        "t", "ts", "2024-01-05", "2024-01-06", "TABLESAMPLE SYSTEM (1)"
    )


@pytest.mark.parametrize(
    "times",
    [{}, {5: 1000}, {0: 1, 4095: 1}, {n: n % 7 for n in range(4096)}, {n: 10**9 if n == 2000 else 1 for n in range(4096)}],
)
@pytest.mark.parametrize("slices", [1, 2, 16, 100])
def test_slices_of_one_day_cover_every_instant_once(spark, times, slices):
    start, end = "2024-02-29", "2024-03-01"
    cuts = slice_cuts(times, start, end, slices)
    predicates = slice_predicates("ts", start, end, cuts)
    assert len(predicates) == slices
    near = [cut + timedelta(microseconds=step) for cut in cuts for step in (-1, 0, 1)]
    day_start, day_end = datetime(2024, 2, 29), datetime(2024, 3, 1)
    edges = [t + timedelta(microseconds=step) for t in (day_start, day_end) for step in (-1, 0, 1)]
    instants = [(t,) for t in {*near, *edges, *(day_start + timedelta(minutes=17 * n) for n in range(84))}]
    df = spark.createDataFrame(instants, "ts timestamp_ntz")
    hits = sum((F.expr(p).cast("int") for p in predicates), F.lit(0))
    inside = (F.col("ts") >= F.lit(day_start).cast("timestamp_ntz")) & (F.col("ts") <= F.lit(day_end).cast("timestamp_ntz"))
    assert df.filter(hits != inside.cast("int")).isEmpty()


def test_slices_follow_the_rows():
    start, end, bins = "2024-01-05", "2024-01-08", 4096
    times = {n: (100 if n < 512 else 1) for n in range(bins)}
    cuts = slice_cuts(times, start, end, 16)
    width = timedelta(days=3) / bins
    edges = [datetime(2024, 1, 5), *cuts, datetime(2024, 1, 8)]
    rows = [
        sum(n for b, n in times.items() if low <= datetime(2024, 1, 5) + (b + 0.5) * width < high)
        for low, high in zip(edges, edges[1:])
    ]
    assert len(rows) == 16 and sum(rows) == sum(times.values())
    assert max(rows) <= sum(times.values()) / 16 + 200


def test_a_day_of_a_database_table_in_slices(spark, monkeypatch):
    asked, queries = [], []

    def jdbc(reader, url, table, predicates=None, properties=None, **_):
        asked.append((table, predicates, properties))
        return decoded(spark, document()).withColumnRenamed("ts", "at")

    def query(session, connection, sql):
        queries.append(sql)
        return spark.createDataFrame([(0, 30), (4095, 10)], "bin bigint, times bigint")

    monkeypatch.setattr("pyspark.sql.readwriter.DataFrameReader.jdbc", jdbc)
    monkeypatch.setattr("metertide.sources.jdbc.read_query", query)
    found = collect_from_database(
        spark, CONNECTION, "decoded", "at", "2024-01-05", "2024-01-06", slices=8, sample="TABLESAMPLE SYSTEM (2)"
    )
    assert found.schema == MESSAGES and found.first().Timestamp == "2024-01-05T10:00:00"
    assert queries == [histogram_sql("decoded", "at", "2024-01-05", "2024-01-06", "TABLESAMPLE SYSTEM (2)")]
    ((table, predicates, properties),) = asked
    assert table == "decoded" and len(predicates) == 8 and properties == CONNECTION.driver_properties()
    cuts = slice_cuts({0: 30, 4095: 10}, "2024-01-05", "2024-01-06", 8)
    assert predicates == slice_predicates("at", "2024-01-05", "2024-01-06", cuts)
    assert sum(cut < datetime(2024, 1, 5, 0, 1) for cut in cuts) == 6


@pytest.fixture
def written(monkeypatch):
    """Frames that would be written to a database, with the call; none is opened."""
    from pyspark.sql.readwriter import DataFrameWriter

    calls = []

    def jdbc(writer, url, table, mode=None, properties=None):
        calls.append((writer._df, (url, table, mode, properties)))

    monkeypatch.setattr(DataFrameWriter, "jdbc", jdbc)
    return calls


def test_append_to_table_shuffles_to_its_connections(spark, written):
    grouped = spark.range(100).groupBy((F.col("id") % 7).alias("id")).count()
    append_to_table(grouped, CONNECTION, "device", ["id"], connections=3)
    ((frame, call),) = written
    assert call == (CONNECTION.url, "device", "append", CONNECTION.driver_properties())
    assert frame.columns == ["id"] and frame.rdd.getNumPartitions() == 3
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Repartition 3, true")


def test_files_with_repeated_headers_go_to_a_table(spark, tmp_path, written):
    (tmp_path / "a.csv").write_text("a,id\nx,1\na,id\ny,2\n")
    schema = spark.createDataFrame([], "id bigint, a string").schema
    load_table_from_files(spark, str(tmp_path), schema, CONNECTION, "device", ["id"])
    ((frame, _),) = written
    assert rows_of(frame) == [(1,), (2,)]


def test_a_period_of_a_database_table_becomes_messages(spark, monkeypatch):
    asked = []

    def jdbc(reader, url, table, predicates=None, properties=None, **_):
        asked.append((url, table, predicates, properties))
        return decoded(spark, document()).withColumnRenamed("ts", "at")

    monkeypatch.setattr("pyspark.sql.readwriter.DataFrameReader.jdbc", jdbc)
    found = collect_from_database(spark, CONNECTION, "decoded", "at", "2024-01-04", "2024-01-06")
    assert found.schema == MESSAGES and found.first().Timestamp == "2024-01-05T10:00:00"
    ((url, table, predicates, _),) = asked
    assert (url, table) == (CONNECTION.url, "decoded")
    assert predicates == day_predicates("at", "2024-01-04", "2024-01-06") and len(predicates) == 3
