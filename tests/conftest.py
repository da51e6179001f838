from __future__ import annotations

import os
import sys
import tempfile
from pathlib import Path

import pytest

os.environ.setdefault("OMP_NUM_THREADS", "1")
ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

from pyspark.sql import SparkSession  # noqa: E402

DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark():
    scratch = tempfile.mkdtemp(prefix="spark-")
    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.local.dir", scratch).config("spark.checkpoint.dir", f"file://{scratch}/checkpoint").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    path = DATA / "sf0.001"
    if not path.is_dir():
        pytest.skip("no test tables here")
    return str(path)


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows_of(frame):
    """Comparable rows of a pandas frame: columns by name, rows sorted, doubles rounded."""
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        kind = str(frame[c].dtype)
        if kind.startswith("datetime"):
            frame[c] = frame[c].astype("datetime64[us]").astype(str)
        elif kind.startswith("float"):
            frame[c] = frame[c].round(6) + 0.0
    return sorted(map(tuple, frame.astype(object).where(frame.notna(), None).astype(str).values.tolist()))
