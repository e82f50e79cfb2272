from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"
DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory) -> SparkSession:
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.default.parallelism", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    db = duckdb.connect()
    for path in Path(DATA, "sf0.001").glob("*.parquet"):
        db.execute(f"create view {path.stem} as select * from '{path}'")
    return db


def same_rows(frame, found, names) -> None:
    """Asserts equal rows, whatever their order, with floats to nine places."""

    def plain(v):
        if isinstance(v, float):
            return round(v, 9)
        return tuple(map(plain, v)) if isinstance(v, list | tuple) else v

    keys = sorted(names)
    assert sorted(frame.columns) == keys
    at = [names.index(k) for k in keys]
    ours = sorted((tuple(plain(r[k]) for k in keys) for r in frame.collect()), key=repr)
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in found), key=repr)
    assert ours == theirs
