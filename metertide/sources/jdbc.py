"""SQL databases over JDBC. The driver jar comes with the session (``spark.jars.packages``)."""

from bisect import bisect_left
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession

#: Bins of the histogram that slices are cut by: the most rows that its query returns.
BINS = 4096


@dataclass(frozen=True)
class Connection:
    """Where a database is and how to log in; ``properties`` go to the JDBC driver as they are."""

    url: str
    user: str | None = None
    password: str | None = field(default=None, repr=False)
    properties: Mapping[str, str] = field(default_factory=dict)

    def driver_properties(self) -> dict[str, str]:
        login = {"user": self.user, "password": self.password}
        return {k: v for k, v in login.items() if v is not None} | dict(self.properties)

    @staticmethod
    def postgres(host: str, database: str, user: str, password: str, port: int = 5432):
        return Connection(
            f"jdbc:postgresql://{host}:{port}/{database}",
            user,
            password,
            {"driver": "org.postgresql.Driver", "fetchsize": "10000"},
        )


def read_query(spark: SparkSession, connection: Connection, sql: str) -> DataFrame:
    """The rows of a SELECT, over one connection; for results that one task can read."""
    return (
        spark.read.format("jdbc")
        .options(url=connection.url, query=sql, **connection.driver_properties())
        .load()
    )


def read_table(
    spark: SparkSession,
    connection: Connection,
    table: str,
    predicates: Sequence[str],
) -> DataFrame:
    """A table, or ``(SELECT ...) name``, one partition and connection per condition.

    The conditions must not overlap and must cover the rows wanted. For a result that one task can
    read there is ``read_query``.
    """
    return spark.read.jdbc(
        connection.url,
        table,
        predicates=list(predicates),
        properties=connection.driver_properties(),
    )


def read_table_by_range(
    spark: SparkSession,
    connection: Connection,
    table: str,
    column: str,
    lower: int | str,
    upper: int | str,
    partitions: int,
) -> DataFrame:
    """A table in parallel slices of a number, date or timestamp column; the bounds filter nothing."""
    return spark.read.jdbc(
        connection.url,
        table,
        column=column,
        lowerBound=lower,
        upperBound=upper,
        numPartitions=partitions,
        properties=connection.driver_properties(),
    )


def _day(text: str) -> datetime:
    return datetime.strptime(text, "%Y-%m-%d")


def _instant(time: datetime) -> str:
    return f"TIMESTAMP '{time.isoformat(' ', 'microseconds' if time.microsecond else 'seconds')}'"


def day_predicates(column: str, start: str, end: str) -> list[str]:
    """One condition per day from ``start`` through the first instant of ``end``."""
    first, last = _day(start), _day(end)
    days = [first + timedelta(days=n) for n in range((last - first).days)]
    return [
        f"{column} >= {_instant(day)} AND {column} < {_instant(day + timedelta(days=1))}"
        for day in days
    ] + [f"{column} = {_instant(last)}"]


def histogram_sql(
    table: str, column: str, start: str, end: str, sample: str = "", bins: int = BINS
) -> str:
    """A SELECT of ``bin, times``: how many rows of the period each of ``bins`` equal stretches holds.

    The database counts, so at most ``bins`` rows come back, whatever the table. ``sample`` is a clause of
    its dialect after the table, such as ``TABLESAMPLE SYSTEM (1)``, for counts from a share of it.
    """
    first, last = _day(start), _day(end)
    seconds = max(1.0, (last - first).total_seconds()) / bins
    return (
        f"SELECT CAST(FLOOR(EXTRACT(EPOCH FROM ({column} - {_instant(first)})) / {seconds!r}) AS BIGINT)"
        f" AS bin, COUNT(*) AS times FROM {table} {sample} WHERE {column} >= {_instant(first)}"
        f" AND {column} < {_instant(last)} GROUP BY 1"
    )


def slice_cuts(
    times: Mapping[int, int], start: str, end: str, slices: int, bins: int = BINS
) -> list[datetime]:
    """Instants that cut the period into ``slices`` of near equal numbers of rows, by a histogram.

    A cut inside a bin takes its rows as evenly spread, so a bin that holds much is cut by time. Without
    any row the cuts are even. There are fewer than asked only if the period has fewer microseconds.
    """
    first, length = _day(start), _day(end) - _day(start)
    filled = sorted((b, n) for b, n in times.items() if n > 0 and 0 <= b < bins)
    filled = filled or [(b, 1) for b in range(bins)]
    upto = list(accumulate(n for _, n in filled))
    cuts = set()
    for k in range(1, slices):
        rank = upto[-1] * k / slices
        place = bisect_left(upto, rank)
        number, rows = filled[place]
        share = (number + (rank - (upto[place] - rows)) / rows) / bins
        cuts.add(first + timedelta(microseconds=int(share * (length // timedelta(microseconds=1)))))
    return sorted(cuts - {first, first + length})


def slice_predicates(column: str, start: str, end: str, cuts: Sequence[datetime]) -> list[str]:
    """One condition per slice between ``cuts``, from ``start`` through the first instant of ``end``."""
    first, last = _day(start), _day(end)
    edges = [first, *cuts]
    conditions = [
        f"{column} >= {_instant(low)} AND {column} < {_instant(high)}"
        for low, high in zip(edges, edges[1:], strict=False)
    ]
    return [*conditions, f"{column} >= {_instant(edges[-1])} AND {column} <= {_instant(last)}"]


def read_period(
    spark: SparkSession,
    connection: Connection,
    table: str,
    column: str,
    start: str,
    end: str,
    slices: int,
    sample: str = "",
) -> DataFrame:
    """The rows of a period, through the first instant of ``end``, in so many slices and connections.

    One query first counts rows by stretches of the period, and slices are cut by these counts, so a busy
    hour is read by more tasks than a quiet one. Counts only affect the work: every instant of the
    period lies in just one slice, whatever has changed since.
    """
    counted = read_query(spark, connection, histogram_sql(table, column, start, end, sample))
    times = {int(row[0]): int(row[1]) for row in counted.collect()}
    cuts = slice_cuts(times, start, end, slices)
    return read_table(spark, connection, table, slice_predicates(column, start, end, cuts))
