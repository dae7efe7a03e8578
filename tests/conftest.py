from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"  # for the Python workers
SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    shared = tmp_path_factory.mktemp("shared")
    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.default.parallelism", "4").config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{shared}")
        .config("spark.sql.warehouse.dir", str(shared / "warehouse")).config("spark.local.dir", str(tmp_path_factory.mktemp("local"))).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return con


def plain(v):
    """A value in a form that both engines share."""
    if v is None or str(v) in ("<NA>", "NaT", "nan"):
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, int):
        return str(v)
    return str(v)


def rows(df):
    """Rows of a pandas frame, in an order of their own, columns by name."""
    df = df[sorted(df.columns)]
    out = []
    for r in df.itertuples(index=False):
        cells = []
        for v in r:
            v = plain(v)
            try:
                v = f"{float(v):.9g}" if v is not None else None
            except ValueError:
                pass
            cells.append(str(v))
        out.append(tuple(cells))
    return sorted(out)
