from collections.abc import Sequence

from pyspark.sql import DataFrame

from metertide.sources.jdbc import Connection


def append_to_table(
    df: DataFrame,
    connection: Connection,
    table: str,
    columns: Sequence[str] | None = None,
    connections: int = 8,
) -> None:
    """Insert the given columns into a table, over at most ``connections`` connections at a time.

    Rows are dealt out to that many partitions by a shuffle of their own; the writer's own limit
    would make the stages before it run in as few tasks. Each partition commits by itself. A job that is run again after a failure may therefore insert
    rows twice; load into a staging table where that matters.
    """
    chosen = df if columns is None else df.select(list(columns))
    chosen.repartition(connections).write.jdbc(
        connection.url, table, mode="append", properties=connection.driver_properties()
    )
