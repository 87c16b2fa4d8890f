import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    spark = (SparkSession.builder.master("local[4]").appName("wakeline-tests")
             .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


@pytest.fixture(scope="session")
def fleet(spark):
    """Three vessels with random walks, one of them far busier than the rest."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(7)
    frames, next_id = [], 0
    for mmsi, n in ((200000001, 60), (200000002, 45), (200000003, 400)):
        gaps = rng.choice([60, 300, 900, 2400], n, p=[0.5, 0.3, 0.15, 0.05])
        frames.append(pd.DataFrame({
            "event_id": np.arange(next_id, next_id + n), "mmsi": mmsi,
            "time": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.cumsum(gaps), unit="s"),
            "lat": 62 + np.cumsum(rng.normal(0, 0.002, n)), "lon": -6.8 + np.cumsum(rng.normal(0, 0.004, n)),
            "sog": np.round(rng.uniform(0, 25, n), 1), "cog": np.round(rng.uniform(0, 359, n), 1),
            "heading": np.round(rng.uniform(0, 359, n), 0), "msg_type": 1,
        }))
        next_id += n
    pdf = pd.concat(frames, ignore_index=True)
    pdf.loc[::17, "sog"] = None
    schema = ("event_id long, mmsi long, time timestamp, lat double, lon double, sog double, cog double, "
              "heading double, msg_type int")
    rows = [tuple(None if pd.isna(v) else v for v in r) for r in pdf.itertuples(index=False)]
    rows = [(int(r[0]), int(r[1]), r[2].to_pydatetime(), *[None if v is None else float(v) for v in r[3:8]], int(r[8])) for r in rows]
    return spark.createDataFrame(rows, schema)
