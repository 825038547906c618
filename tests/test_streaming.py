import datetime as dt

import numpy as np
import pandas as pd

from tidemark.streaming.live import live_crossover


def drain(df, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_crossover_over_batches(spark, tmp_path):
    rng = np.random.default_rng(2)
    closes = 100 + rng.normal(size=40).cumsum()
    rows = [("s", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=5 * i), float(c)) for i, c in enumerate(closes)]
    schema = "symbol string, time timestamp, close double"
    for k in range(4):  # a file is a batch; each comes unordered, the third with a late bar
        part = rows[10 * k:10 * k + 10][::-1] + ([("s", rows[3][1], 1.0)] if k == 2 else []) + [("t", rows[k][1], 1.0), ("t", None, 1.0)]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = drain(live_crossover(stream, 3, 6), "live", tmp_path).toPandas()
    s = out[out.symbol == "s"].sort_values("time")
    want = pd.Series(closes).ewm(span=3, min_periods=3, adjust=False).mean()
    np.testing.assert_allclose(s["fast"].to_numpy(float), want)
    slow = pd.Series(closes).ewm(span=6, adjust=False).mean()
    assert s["direction"].iloc[6:].tolist() == np.sign(want - slow).iloc[6:].tolist() and (s["direction"].iloc[:6] == 0).all()
