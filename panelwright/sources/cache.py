"""Versioned datasets: compute once per configuration, read back afterwards."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelwright.sources import commit


def materialize(
    spark: SparkSession,
    base: str,
    config: dict,
    build: Callable[[], dict[str, DataFrame]],
    names: tuple[str, ...] = ("train", "test"),
    use_cached: bool = True,
    force: bool = False,
) -> dict[str, DataFrame]:
    """Tables ``names`` below ``base/<version>``. They are read back if all of them exist,
    unless that is switched off; otherwise they are built, written as parquet together with
    the configuration, and read back.

    Every write goes to a folder of its own; a manifest that names all tables and the
    configuration is committed last. Readers follow the newest manifest, so they see the tables of
    one write, whole, while another goes on or after one has failed. Earlier tables stay readable;
    ``clean`` removes them."""
    enabled = config.get("cache", {}).get("enabled", True)
    folder = f"{base.rstrip('/')}/{config.get('version', 'unknown')}"
    if enabled and use_cached and not force:
        manifest = commit.newest(spark, folder)
        if manifest and set(names) <= set(manifest["tables"]):
            return {n: spark.read.parquet(f"{folder}/{manifest['tables'][n]}") for n in names}
    tables = build()
    if not enabled:
        return tables
    own = f"data-{uuid.uuid4().hex}"
    for n in names:
        tables[n].write.parquet(f"{folder}/{own}/{n}")
    commit.put(spark, f"{folder}/config/{own}.json", json.dumps(config, sort_keys=True))  # what counts is in the manifest
    commit.commit(spark, folder, {"config": config, "tables": {n: f"{own}/{n}" for n in names}})
    return {n: spark.read.parquet(f"{folder}/{own}/{n}") for n in names}


def clean(spark: SparkSession, base: str, version: str) -> int:
    """Removes the tables of a version that its newest manifest does not name, unfinished ones too;
    returns how many writes went. To be called when nothing writes or reads older ones."""
    folder = f"{base.rstrip('/')}/{version}"
    manifest = commit.newest(spark, folder)
    kept = {t.split("/")[0] for t in manifest["tables"].values()} if manifest else set()
    old = [n for n in commit.names(spark, folder) if n.startswith("data-") and n not in kept]
    return sum(commit.remove(spark, f"{folder}/{n}") for n in old)
