"""Reports that follow their history part by part, and the versions of its runs."""

import random
from datetime import date, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from metertide.operators.runs import consecutive_flow_state, find_leaks, flow_runs
from metertide.operators.stretches import (
    STRETCH,
    leaks_of_stretches,
    number_stretches,
    stretch_days,
    stretch_runs,
)
from metertide.plans.incremental import HistoryDays, write_history_reports
from metertide.plans.reports import build_reports, input_identity, write_reports
from metertide.schemas import DAY_FLOWS
from metertide.sinks.files import append_history, remove_old_versions
from metertide.sinks.parts import PartStore
from metertide.sources.history import (
    current_runs,
    period_identity,
    read_distinct,
    read_history,
    runs_by_date,
)
from metertide.versions import current_version, publish, read_text, replace_text
from metertide.workspace import temporary_tables
from tests.builders import message, messages

START, END = "2024-01-25", "2024-02-10"


def rows_of(df):
    return sorted((tuple(row) for row in df.collect()), key=str)


def sent_at(day, hour, minute=0):
    return f"{date(2024, 1, 20) + timedelta(days=day)}T{hour:02}:{minute:02}:00"


def random_messages(seed, count=400):
    """Messages around and at the bounds of the period, with repeats and devices without an id."""
    rng = random.Random(seed)
    rows = []
    for _ in range(count):
        device = rng.choice(["A", "B", "B ", "C", "D", None])
        flows = [rng.choice([0, 0, 3, 255, None]) for _ in range(8)] if rng.random() < 0.5 else [rng.choice([0, 4])] * 8
        rows.append(message(
            device, sent_at(rng.randrange(24), rng.choice([0, 3, 8, 8, 12, 23]), rng.choice([0, 45])), flows,
            rng.choice([8, 8, 8, 8, 4, None]), rng.choice([1, 1, 1, 2]), rng.choice([4, 4, 4, 1]), rng.randrange(3),
        ))
    rows += [message("E", f"{END}T00:00:00"), message("F", f"{END}T00:00:01"), message("G", f"{START}T00:00:00")]
    return rows + rng.sample(rows, count // 8)


def append(spark, root, run, rows, namespace="ns", buckets=None):
    append_history(messages(spark, *rows), root, namespace, run, buckets=buckets)


def same_as_a_full_build(spark, root, output):
    reports = write_history_reports(spark, root, output, "ns", START, END)
    full = build_reports(read_history(spark, root, "ns"), START, END)
    assert set(reports) == set(full)
    for name, df in full.items():
        assert [(f.name, f.dataType) for f in reports[name].schema] == [(f.name, f.dataType) for f in df.schema], name
        assert rows_of(reports[name]) == rows_of(df), name


@pytest.mark.parametrize("seed, buckets", [(1, None), (2, None), (1, 5)])
def test_reports_of_random_splits_are_those_of_a_full_build(spark, tmp_path, seed, buckets):
    rng = random.Random(seed)
    root, output = str(tmp_path / "history"), str(tmp_path / "out")
    rows = random_messages(seed)
    cut = rng.randrange(100, 300)
    append(spark, root, "one", rows[:cut], buckets=buckets)
    append(spark, root, "two", rows[cut - 50 :], buckets=buckets)  # overlaps
    append(spark, root, "other", rows[:9], "elsewhere")
    same_as_a_full_build(spark, root, output)
    append(spark, root, "late", random_messages(seed + 10, 30), buckets=buckets)
    same_as_a_full_build(spark, root, output)


def history_days(spark, root, store, end=END):
    return HistoryDays(spark, root, store, "ns", START, end)


def test_a_late_run_reads_its_dates_and_numbers_its_months_only(spark, tmp_path):
    root, store = str(tmp_path / "history"), str(tmp_path / "kept")
    append(spark, root, "one", random_messages(3))
    days = history_days(spark, root, store)
    assert days.refresh_dates() == [str(date(2024, 1, 25) + timedelta(days=n)) for n in range(16)]
    assert days.refresh_months() == ["2024-01", "2024-02"]
    assert days.refresh_dates() == days.refresh_months() == []

    append(spark, root, "late", [message("A", "2024-02-05T09:00:00"), message("A", "2024-02-08T03:00:00")])
    days = history_days(spark, root, store)
    read = []
    plain = days.messages
    days.messages = lambda held: read.append(list(held)) or plain(held)
    assert days.refresh_dates() == ["2024-02-05", "2024-02-08"]
    assert days.refresh_months() == ["2024-02"]
    assert all(held == [END] for held in read)  # the last instant, which is not kept
    runs = days.month_runs()
    assert {f.split("/stretch=")[1][:7] for f in runs.inputFiles()} == {"2024-01", "2024-02"}
    assert all("/months/runs/" in f for f in leaks_of_stretches(runs).inputFiles())

    # On the first of a month: readings reach back to the month before.
    append(spark, root, "first", [message("B", "2024-02-01T03:00:00", flows=[9] * 8)])
    days = history_days(spark, root, store)
    assert days.refresh_dates() == ["2024-02-01"]
    assert days.refresh_months() == ["2024-01", "2024-02"]


def test_a_day_more_leaves_earlier_months_unread(spark, tmp_path):
    root, store = str(tmp_path / "history"), str(tmp_path / "kept")
    append(spark, root, "one", random_messages(4))
    for end, dates, months in (
        ("2024-02-05", 11, ["2024-01", "2024-02"]),
        ("2024-02-06", 1, ["2024-02"]),
        ("2024-02-06", 0, []),
    ):
        days = history_days(spark, root, store, end)
        assert len(days.refresh_dates()) == dates
        assert days.refresh_months() == months


def test_runs_outside_the_period_change_nothing(spark, tmp_path, monkeypatch):
    root, output = str(tmp_path / "history"), str(tmp_path / "out")
    append(spark, root, "one", random_messages(5, 60))
    first = period_identity(current_runs(spark, root, "ns"), START, END)
    write_history_reports(spark, root, output, "ns", START, END)
    # The last date counts by its first instant alone.
    append(spark, root, "next", [message("A", f"{END}T00:00:01"), message("A", "2024-03-05T09:00:00")])
    assert period_identity(current_runs(spark, root, "ns"), START, END) == first
    assert input_identity(read_history(spark, root, "ns"), START, END) == first

    def never(*_, **__):
        raise AssertionError("read")

    with monkeypatch.context() as patch:
        for step in ("day_parts", "device_parts", "stretch_days", "leaks_of_stretches", "device_usage"):
            patch.setattr(f"metertide.plans.incremental.{step}", never)
        patch.setattr("metertide.plans.incremental.HistoryDays._last_instant", never)
        write_history_reports(spark, root, output, "ns", START, END)
    assert len(list(Path(output, f"ns_{START}_{END}").iterdir())) == 1
    append(spark, root, "midnight", [message("Z", f"{END}T00:00:00")])
    assert period_identity(current_runs(spark, root, "ns"), START, END) != first
    assert input_identity(read_history(spark, root, "ns"), START, END) != first
    same_as_a_full_build(spark, root, output)


def test_full_reports_follow_their_period(spark, tmp_path):
    root, output = str(tmp_path / "history"), str(tmp_path / "out")
    tables = lambda: {t.name for t in spark.catalog.listTables()}
    before = tables()
    append(spark, root, "one", random_messages(6, 40))
    write_reports(read_history(spark, root, "ns"), output, "ns", START, END)
    append(spark, root, "two", [message("A", "2024-04-01T09:00:00")])
    write_reports(read_history(spark, root, "ns"), output, "ns", START, END)
    assert len(list(Path(output, f"ns_{START}_{END}").iterdir())) == 1
    assert tables() == before


def test_an_empty_history(spark, tmp_path):
    reports = write_history_reports(spark, str(tmp_path / "none"), str(tmp_path / "out"), "ns", START, END)
    assert reports["usage"].count() == reports["consecutive_flow"].count() == 0
    assert reports["initial_device_count"].first()[0] == 0


def test_a_write_that_breaks_off_leaves_the_former_run(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "history")
    append(spark, root, "one", [message("A")])
    (before,) = current_runs(spark, root)

    def broken(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr("metertide.sinks.files.publish", broken)
        with pytest.raises(RuntimeError, match="lost"):
            append(spark, root, "one", [message("B"), message("C")])
    bad = messages(spark, message("D")).withColumn("Epoch", F.raise_error(F.lit("half-way")).cast("long"))
    with pytest.raises(Exception, match="half-way"):
        append_history(bad, root, "ns", "one")
    assert current_runs(spark, root) == [before]
    assert [r.DeviceID for r in read_history(spark, root).collect()] == ["A"]
    append(spark, root, "one", [message("E")])
    assert [r.DeviceID for r in read_history(spark, root).collect()] == ["E"]
    removed = remove_old_versions(spark, root, "ns")
    assert any(before.version in path for path in removed) and len(removed) >= 2
    assert [r.DeviceID for r in read_history(spark, root).collect()] == ["E"]
    assert len(list(Path(root, "namespace=ns", "run=one").glob("version=*"))) == 1
    assert remove_old_versions(spark, root, "ns") == []


def test_small_files_are_replaced_in_one_step(spark, tmp_path):
    path = str(tmp_path / "folder" / "note")
    assert read_text(spark, path) is None
    for text in ("one", "two é", ""):
        replace_text(spark, path, text)
        assert read_text(spark, path) == text
    assert [p.name for p in (tmp_path / "folder").iterdir() if not p.name.startswith(".")] == ["note"]
    publish(spark, str(tmp_path / "folder"), "v1")
    assert current_version(spark, str(tmp_path / "folder")) == "v1"


def test_parts_are_built_together_and_named_when_complete(spark, tmp_path):
    schema = spark.range(1).schema
    store = PartStore(spark, str(tmp_path), "part", {"numbers": schema})
    asked = []

    def make(parts):
        asked.append(parts)
        rows = [(n, p) for p in parts for n in range(3) if p != "empty"]
        return {"numbers": spark.createDataFrame(rows, "id long, part string")}

    def broken(parts):
        return {"numbers": make(parts)["numbers"].withColumn("id", F.raise_error(F.lit("lost")).cast("long"))}

    wanted = {"a": "1", "b": "1", "empty": "1"}
    with pytest.raises(Exception, match="lost"):
        store.refresh(wanted, broken)
    assert store.refresh(wanted, make) == ["a", "b", "empty"] == asked[-1]
    assert store.refresh(wanted | {"b": "2"}, make) == ["b"]
    assert store.refresh(wanted, make) == []  # both identities of b are kept
    assert rows_of(store.read("numbers", {"b": "2"})) == [(n, "b") for n in range(3)]
    assert store.read("numbers", {"empty": "1"}).count() == 0
    assert store.read("numbers", wanted).count() == 6
    assert len(store.read("numbers", {"a": "1"}).inputFiles()) >= 1
    store.tidy({"a": "1"})
    assert store.read("numbers", {"a": "1"}).count() == 3
    assert store.refresh({"b": "2"}, make) == ["b"]


def random_days(seed):
    rng = random.Random(seed)
    rows = []
    for device in [*map(str, range(12)), None]:
        for n in range(40):
            if rng.random() < 0.8:
                least = rng.choice([0, 0, 2, 2, 2, 5, None])
                rows.append((device, date(2024, 1, 1) + timedelta(days=n), rng.randrange(99), least, rng.random() < 0.1))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_stretches_give_the_runs_of_the_whole_for_any_cutting(spark, seed):
    rng = random.Random(seed)
    days = spark.createDataFrame(random_days(seed), DAY_FLOWS)
    cuts = sorted(rng.sample(range(1, 40), rng.choice([1, 4, 15])))
    stretch = F.lit("00")
    for place, cut in enumerate(cuts, 1):
        begins = F.lit(str(date(2024, 1, 1) + timedelta(days=cut))).cast("date")
        stretch = F.when(F.col("date") >= begins, F.lit(f"{place:02}")).otherwise(stretch)
    cut_days = stretch_days(days, stretch)
    runs = stretch_runs(cut_days)
    assert cut_days.select(STRETCH).distinct().count() > 1
    assert rows_of(leaks_of_stretches(runs)) == rows_of(find_leaks(flow_runs(days)))
    numbered, plain = number_stretches(cut_days, runs), consecutive_flow_state(days)
    assert numbered.columns == plain.columns
    assert rows_of(numbered) == rows_of(plain)


def distinct_of(spark, root, start=START, end=END):
    return read_distinct(spark, root, runs_by_date(current_runs(spark, root, "ns"), start, end))


def test_overlapping_runs_in_buckets_meet_without_a_shuffle(spark, tmp_path):
    root, plain = str(tmp_path / "history"), str(tmp_path / "plain")
    rows = random_messages(8)
    for run, part in (("one", rows[:300]), ("two", rows[200:]), ("three", rows)):
        append(spark, root, run, part, buckets=5)
        append(spark, plain, run, part)
    tables = {t.name for t in spark.catalog.listTables()}
    with temporary_tables(spark):
        found = distinct_of(spark, root)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Bucketed: true" in plan
        expected = distinct_of(spark, plain)
        assert "Exchange" in expected._jdf.queryExecution().executedPlan().toString()
        assert found.columns == expected.columns and rows_of(found) == rows_of(expected)
        assert found.count() == len(set(rows_of(found)))
        by_day = found.filter(F.col("sent") >= F.lit("2024-02-01").cast("timestamp_ntz"))
        assert "Exchange" not in by_day._jdf.queryExecution().executedPlan().toString()
        assert 0 < by_day.count() < found.count()
    assert {t.name for t in spark.catalog.listTables()} == tables
    # A replaced run, and one without buckets beside them.
    append(spark, root, "three", rows[:1], buckets=5)
    append(spark, root, "two", rows[200:])
    assert rows_of(distinct_of(spark, root)) == rows_of(distinct_of(spark, plain))


def test_a_row_of_most_copies_comes_once_per_run_in_buckets(spark, tmp_path):
    root, hot = str(tmp_path / "history"), message("A", f"{START}T09:00:00")
    append(spark, root, "one", [hot] * 500 + random_messages(9, 40), buckets=4)
    append(spark, root, "two", [hot] * 500, buckets=4)
    same = F.struct("DeviceID", "Timestamp", "msgSeq")
    counts = read_history(spark, root).groupBy(same.alias("row"), "run", "rawData", *[f"FLOW{i}" for i in range(1, 9)])
    hottest = counts.count().filter("row.DeviceID = 'A' AND FLOW1 = 1").agg(F.max("count")).first()[0]
    assert hottest == 1
    with temporary_tables(spark):
        assert distinct_of(spark, root).filter(F.col("FLOW8") == 8).filter("DeviceID = 'A'").count() == 1


def test_buckets_of_no_rows_and_of_malformed_times(spark, tmp_path):
    root = str(tmp_path / "history")
    append(spark, root, "none", [], buckets=3)
    assert distinct_of(spark, root).count() == 0
    bad = messages(spark, message("A", "yesterday"), message("B", f"{START}T01:00:00"))
    with pytest.raises(Exception):
        append_history(bad, root, "ns", "one", buckets=3)
    append_history(bad, root, "ns", "one", "null", buckets=3)
    assert read_history(spark, root).count() == 2
    with temporary_tables(spark):
        assert [row.DeviceID for row in distinct_of(spark, root).collect()] == ["B"]
