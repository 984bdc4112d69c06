"""Write, audit, publish: a snapshot becomes readable only when nothing speaks against it."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from evloom.streaming.store import Folder

Audit = Callable[[dict[str, DataFrame]], DataFrame]


class Publications:
    """Snapshots of named tables under one path.

    A snapshot is staged in a folder of its own, and the audit reads the staged files, not the plan that
    made them. Only a snapshot without violations gets a pointer, which appears whole under the next
    number; readers follow the highest pointer. What was refused is deleted, with its violations returned.
    A pointer names the folder of every table, so that a snapshot may keep tables of the one before it.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.folder = spark, path.rstrip("/"), Folder(spark, path)

    def current(self) -> dict | None:
        numbers = sorted(int(n) for n in self.folder.names("pointer") if n.isdigit())
        return json.loads(self.folder.read(f"pointer/{numbers[-1]}")) if numbers else None

    @staticmethod
    def _places(now: dict | None) -> dict[str, str]:
        tables = now["tables"] if now else {}
        return tables if isinstance(tables, dict) else {name: f"{now['snapshot']}/{name}" for name in tables}  # a list in older pointers

    def read(self) -> dict[str, DataFrame]:
        """The published tables; empty before the first publication."""
        return {name: self.spark.read.parquet(f"{self.path}/{place}") for name, place in self._places(self.current()).items()}

    def publish(self, tables: dict[str, DataFrame], audit: Audit, kept: Iterable[str] = ()) -> list[tuple]:
        """Violations as (id, violation), at most a thousand of them; none if the snapshot was published.

        Tables named in ``kept`` are those of the current snapshot: audited with the others, not written again.
        """
        before = self.current()
        snapshot = f"snapshot-{uuid.uuid4().hex}"
        places = {name: self._places(before)[name] for name in kept}
        staged = {name: self.spark.read.parquet(f"{self.path}/{place}") for name, place in places.items()}
        for name, df in tables.items():
            places[name] = f"{snapshot}/{name}"
            df.write.parquet(f"{self.path}/{places[name]}")
            staged[name] = self.spark.read.schema(df.schema).parquet(f"{self.path}/{places[name]}")
        found = [tuple(r) for r in audit(staged).take(1000)]
        if found:
            self.folder.delete(snapshot)
            return found
        number = before["number"] + 1 if before else 1
        self.folder.publish(f"pointer/{number}", json.dumps({"number": number, "snapshot": snapshot, "tables": places}))
        return []
