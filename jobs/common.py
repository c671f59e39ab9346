"""What the jobs' command lines share."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession


def settings_of(config: str | None, defaults: dict) -> dict:
    """The defaults with what a JSON file changes; names that it doesn't know are refused."""
    given = json.loads(Path(config).read_text()) if config else {}
    if unknown := set(given) - set(defaults):
        raise ValueError(f"{config}: unknown settings {sorted(unknown)}")
    return defaults | given


def main(run: Callable, paths: tuple[str, ...], defaults: dict, argv: list[str] | None = None) -> None:
    """Create a session, run a job over the given paths, and stop the session."""
    parser = argparse.ArgumentParser(description=run.__doc__)
    for p in paths:
        parser.add_argument(f"--{p}", required=True)
    parser.add_argument("--config", help="JSON file of settings")
    given = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    settings = settings_of(given.config, defaults)
    spark = SparkSession.builder.appName(run.__module__).getOrCreate()
    try:
        run(spark, *[getattr(given, p) for p in paths], **settings)
    finally:
        spark.stop()
