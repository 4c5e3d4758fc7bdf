"""Immutable versions of named tables.

A version <table>__<hash> is a folder of Parquet files that its manifest entry, written last, names.  So a build that dies
leaves nothing visible, readers need no lock, and writing the same hash again replaces the version without a time at which there is none.
"""

from __future__ import annotations

import datetime as dt
import json
import re
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.sources.files import Files

TABLES = {"features": "date", "universe": "refresh_date", "market": "date", "labels": "date"}
_HASH = re.compile(r"[0-9a-f]{6,64}")


def version_name(table: str, digest: str) -> str:
    """Checked before it becomes part of a path."""
    if table not in TABLES or not _HASH.fullmatch(str(digest)):
        raise ValueError(f"no table version {table!r} / {digest!r}")
    return f"{table}__{digest}"


class TableStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, str(root).rstrip("/"), Files(spark)

    def _entry(self, name: str) -> str:
        return f"{self.root}/_manifest/{name}.json"

    def write(self, table: str, df: DataFrame, digest: str, config: dict[str, Any], plan: str | None = None) -> dict[str, Any]:
        """Writes a version; one that is there already is replaced for new readers, who find it by the manifest's entry.

        Each write has a folder of its own, and the entry, replaced as one file, names it: whoever reads finds the old rows or the new ones.
        Of two writers of the same version at a time the second one is refused.  ``plan`` is what the version was built by, without its source.
        """
        name = version_name(table, digest)
        lock = f"{self.root}/_locks/{name}"
        if not self.files.claim(lock):
            raise RuntimeError(f"{name} is being written by another; if that writer is dead, remove {lock}")
        try:
            folder = f"{name}-{uuid.uuid4().hex[:8]}"
            df.write.parquet(f"{self.root}/{folder}")
            c = TABLES[table]
            n, lo, hi = self.spark.read.parquet(f"{self.root}/{folder}").agg(F.count(F.lit(1)), F.min(c), F.max(c)).first()  # reads one column
            before = self.files.read_json(self._entry(name))["folder"] if self.has(table, digest) else None
            entry = {"table_name": table, "config_hash": digest, "plan_hash": plan, "folder": folder, "n_rows": n, "min_date": str(lo) if lo else None, "max_date": str(hi) if hi else None, "built_at": dt.datetime.now(dt.timezone.utc).isoformat(), "config": config}
            self.files.write_text(self._entry(name), json.dumps(entry, default=str))
            if before:
                self.files.remove(f"{self.root}/{before}")
        finally:
            self.files.remove(lock)
        return entry

    def versions(self, table: str | None = None) -> list[dict[str, Any]]:
        """Manifest entries, oldest first."""
        found = [self.files.read_json(f"{self.root}/_manifest/{n}") for n in self.files.names(f"{self.root}/_manifest") if n.endswith(".json")]
        return sorted((e for e in found if table in (None, e["table_name"])), key=lambda e: e["built_at"])

    def has(self, table: str, digest: str) -> bool:
        return self.files.exists(self._entry(version_name(table, digest)))

    def read(self, table: str, digest: str, where: str | None = None) -> DataFrame:
        name = version_name(table, digest)
        if not self.has(table, digest):
            raise FileNotFoundError(f"{self.root} holds no {name}")
        df = self.spark.read.parquet(f"{self.root}/{self.files.read_json(self._entry(name))['folder']}")
        return df.where(where) if where else df

    def drop(self, table: str, digest: str) -> None:
        name = version_name(table, digest)
        folder = self.files.read_json(self._entry(name))["folder"]
        self.files.remove(self._entry(name))  # invisible first
        self.files.remove(f"{self.root}/{folder}")
