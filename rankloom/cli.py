"""Command line: python -m rankloom.cli COMMAND SPEC [--env NAME] [--start DAY] [--end DAY]."""

from __future__ import annotations

import argparse
import datetime as dt
import json
import sys

import yaml

from rankloom import registry
from rankloom.plans import pipeline
from rankloom.plans.spec import load
from rankloom.session import get_spark

HELP = {
    "validate": "check a spec and print it with all defaults",
    "build-dataset": "build the table versions that are missing",
    "train": "new run: fit all folds and write predictions",
    "evaluate": "metrics of an existing run",
    "backtest": "simulation of an existing run",
    "run": "new run with all stages",
    "gc": "table versions that no run uses",
}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="rankloom", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("components", help="all registered components")
    for name, text in HELP.items():
        p = commands.add_parser(name, help=text)
        p.add_argument("spec")
        p.add_argument("--env")
        for t in ("--start", "--end"):
            p.add_argument(t, type=dt.date.fromisoformat)
        if name in ("evaluate", "backtest"):
            p.add_argument("--run-dir", required=True)
        if name in ("build-dataset", "run"):
            p.add_argument("--force", action="store_true")
        if name == "gc":
            p.add_argument("--yes", action="store_true", help="drop them")
    a = parser.parse_args(argv)
    if a.command == "components":
        for kind in registry.KINDS:
            print(f"{kind}: {', '.join(registry.names(kind)) or '-'}")
        return 0
    spec = load(a.spec, a.env, {"start": a.start, "end": a.end})
    if a.command == "validate":
        print(yaml.safe_dump(json.loads(json.dumps(spec, default=str)), sort_keys=False), end="")
        print(f"hash {spec.hash()}", file=sys.stderr)
        return 0
    spark = get_spark()
    if a.command == "build-dataset":
        for t, h in pipeline.build(spark, spec, a.force).items():
            print(t, h)
    elif a.command == "gc":
        for t, h in pipeline.unused(spark, spec, a.yes):
            print("dropped" if a.yes else "unused", t, h)
    else:
        stages = pipeline.STAGES if a.command == "run" else (a.command,)
        print(pipeline.run(spark, spec, stages, getattr(a, "run_dir", None), getattr(a, "force", False)).folder)
    return 0


if __name__ == "__main__":
    sys.exit(main())
