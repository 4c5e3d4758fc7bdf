"""Run folders: the resolved spec, what it was run with, its metrics and its log.

All of a run's files go through the file system that Spark writes its tables to, so they lie in one folder wherever the driver runs.
"""

from __future__ import annotations

import datetime as dt
import io
import json
import logging
import platform
import subprocess
from importlib import metadata
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import SparkSession

from rankloom.plans.spec import Spec
from rankloom.sources.files import Files

log = logging.getLogger("rankloom.runs")
PACKAGES = ("pyspark", "numpy", "pandas", "pyarrow")


def _now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc)


def _git(*args: str) -> str | None:
    try:
        return subprocess.run(["git", *args], cwd=Path(__file__).parent, capture_output=True, text=True, check=True, timeout=20).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        return None


class Run:
    """A context: status is 'running' inside, then 'finished' or 'failed'."""

    def __init__(self, spark: SparkSession, spec: Spec, folder: str | Path | None = None):
        self.spec, self.files = spec, Files(spark)
        if folder is None:
            stem = f"{spec['paths']['runs_root'].rstrip('/')}/{_now():%Y%m%dT%H%M%SZ}_{spec['name']}_{spec.hash()[:6]}"
            folder, n = stem, 0
            while not self.files.claim(f"{folder}/_claimed"):
                n += 1
                folder = f"{stem}_{n}"
        self.folder = str(folder).rstrip("/")
        self._log = io.StringIO()
        self._handler: logging.Handler | None = None

    @property
    def name(self) -> str:
        return self.folder.rsplit("/", 1)[-1]

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def _json(self, name: str) -> dict[str, Any]:
        return self.files.read_json(self.path(name)) if self.files.exists(self.path(name)) else {}

    def _put(self, name: str, facts: dict[str, Any]) -> None:
        self.files.write_text(self.path(name), json.dumps(facts, indent=2, sort_keys=True, default=str))

    def meta(self) -> dict[str, Any]:
        return self._json("meta.json")

    def note(self, **facts: Any) -> None:
        self._put("meta.json", {**self.meta(), **facts})

    def metrics(self) -> dict[str, float]:
        return self._json("metrics.json")

    def record(self, values: dict[str, Any], prefix: str = "") -> None:
        """Adds numbers under prefix/name; anything else is refused.  A missing value is left out."""
        for k, v in values.items():
            if isinstance(v, bool) or not isinstance(v, (int, float, type(None))):
                raise TypeError(f"{k} is no number: {v!r}")
        self._put("metrics.json", {**self.metrics(), **{f"{prefix}/{k}" if prefix else k: float(v) for k, v in values.items() if v is not None}})

    def __enter__(self) -> Run:
        if self.files.exists(self.path("run.log")):
            self._log.write(self.files.read_text(self.path("run.log")))
        self._handler = logging.StreamHandler(self._log)
        self._handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
        root = logging.getLogger("rankloom")
        root.addHandler(self._handler)
        root.setLevel(logging.INFO)
        if not self.files.exists(self.path("config.resolved.yaml")):
            self.files.write_text(self.path("config.resolved.yaml"), yaml.safe_dump(json.loads(json.dumps(self.spec, default=str)), sort_keys=False))
        versions = {"python": platform.python_version()}
        for p in PACKAGES:
            try:
                versions[p] = metadata.version(p)
            except metadata.PackageNotFoundError:
                versions[p] = None
        self.note(run_id=self.name, config_hash=self.spec.hash(), git_sha=_git("rev-parse", "HEAD"), git_dirty=bool(_git("status", "--porcelain")), versions=versions, started_at=_now().isoformat(), status="running")
        return self

    def __exit__(self, kind, value, trace) -> None:
        if kind:
            log.error("run failed", exc_info=(kind, value, trace))
        logging.getLogger("rankloom").removeHandler(self._handler)
        self.files.write_text(self.path("run.log"), self._log.getvalue())
        self.note(status="failed" if kind else "finished", finished_at=_now().isoformat())
