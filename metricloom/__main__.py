"""Command line: validate or compile model files, or run a text against Parquet tables.

python -m metricloom validate [PATH]
python -m metricloom compile [PATH]
python -m metricloom run TEXT [--models PATH] [--tables FOLDER]
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from metricloom.errors import MetricloomError
from metricloom.plans.model import parse_model
from metricloom.plans.state import StateManager, read_models


def validate(path: str) -> int:
    """PASS or FAIL for each file; 1 if any fails."""
    failed = files = 0
    for name, text in read_models(path):
        files += 1
        try:
            parse_model(text)
            print(f"PASS {name}")
        except MetricloomError as e:
            failed += 1
            print(f"FAIL {name}: {e}", file=sys.stderr)
    print(f"{files} files, {failed} errors")
    return int(failed > 0)


def compile_models(path: str) -> int:
    state = StateManager()
    state.load_dir(path)
    s = state.stats()
    print(f"{s.models} models, {s.entities} entities, {s.metrics} metrics")
    return 0


def run(text: str, models: str | None, tables: str | None) -> int:
    from pyspark.sql import SparkSession

    from metricloom.engine import Engine

    engine = Engine(SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate())
    if models:
        engine.load_dir(models)
    if tables:
        engine.sources.parquet_dir(tables, *(p.stem for p in sorted(Path(tables).glob("*.parquet"))))
    df = engine.execute(text)
    if df is None:
        print("OK")
    else:
        df.show(truncate=False)
    return 0


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="metricloom")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("validate", "compile"):
        commands.add_parser(name).add_argument("path", nargs="?", default=".")
    r = commands.add_parser("run")
    r.add_argument("text")
    r.add_argument("--models")
    r.add_argument("--tables")
    a = parser.parse_args(args)
    try:
        return validate(a.path) if a.command == "validate" else compile_models(a.path) if a.command == "compile" else run(a.text, a.models, a.tables)
    except MetricloomError as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
