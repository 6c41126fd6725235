"""Tables kept part by part (a date, a month), so that a new input rebuilds only the parts it touches."""

import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from metertide.versions import POINTER, exists, matching, read_text, replace_text
from metertide.workspace import delete


class PartStore:
    """Named tables under one folder, cut into parts by ``column``, which holds the part's name.

    Each part is kept with an identity of what it was made of. Parts that are missing are built together,
    by one job a table, into folders of their own; then one small file, replaced in one step, names them. A
    build that breaks off leaves no trace in it. Parts of earlier identities stay until ``tidy``.
    """

    def __init__(
        self, spark: SparkSession, root: str, column: str, schemas: Mapping[str, StructType]
    ) -> None:
        self.spark, self.root, self.column, self.schemas = spark, root, column, dict(schemas)

    def _entries(self) -> dict[str, dict]:
        return json.loads(read_text(self.spark, f"{self.root}/{POINTER}") or "{}")

    def _folder(self, name: str, build: str, part: str) -> str:
        return f"{self.root}/{name}/build={build}/{self.column}={part}"

    def refresh(
        self,
        wanted: Mapping[str, str],
        make: Callable[[list[str]], Mapping[str, DataFrame]],
        rebuild: bool = False,
    ) -> list[str]:
        """Build what is missing of the parts wanted, each with its identity; returns their names.

        ``make`` takes the names and returns all tables, with rows of those parts only.
        """
        entries = self._entries()
        missing = [p for p, identity in wanted.items() if rebuild or f"{p} {identity}" not in entries]
        if not missing:
            return []
        build = uuid.uuid4().hex
        for name, table in make(missing).items():
            columns = [*self.schemas[name].fieldNames(), self.column]
            table.select(*columns).hint("rebalance", self.column).write.partitionBy(self.column).parquet(
                f"{self.root}/{name}/build={build}"
            )
        # Others may have built parts meanwhile.
        entries = self._entries()
        for part in missing:
            tables = [n for n in self.schemas if exists(self.spark, self._folder(n, build, part))]
            entries[f"{part} {wanted[part]}"] = {"build": build, "tables": tables}
        replace_text(self.spark, f"{self.root}/{POINTER}", json.dumps(entries))
        return missing

    def read(self, name: str, wanted: Mapping[str, str]) -> DataFrame:
        """The rows of the parts wanted; no other part is listed or read."""
        entries, paths = self._entries(), []
        for part, identity in wanted.items():
            entry = entries[f"{part} {identity}"]
            if name in entry["tables"]:
                paths.append(self._folder(name, entry["build"], part))
        schema = StructType([*self.schemas[name].fields]).add(self.column, "string")
        if not paths:
            return self.spark.createDataFrame([], schema)
        found = self.spark.read.schema(schema.add("build", "string")).option(
            "basePath", f"{self.root}/{name}"
        )
        return found.parquet(*paths).drop("build")

    def tidy(self, wanted: Mapping[str, str]) -> None:
        """Forget all parts but those wanted, and remove builds that hold none of them. Not while others
        build."""
        entries = self._entries()
        kept = {key: e for key, e in entries.items() if key in {f"{p} {i}" for p, i in wanted.items()}}
        replace_text(self.spark, f"{self.root}/{POINTER}", json.dumps(kept))
        builds = {entry["build"] for entry in kept.values()}
        for name in self.schemas:
            for path in matching(self.spark, f"{self.root}/{name}/build=*"):
                if path.rsplit("=", 1)[1] not in builds:
                    delete(self.spark, path)
