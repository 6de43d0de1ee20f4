import pandas as pd
from pyspark.sql import functions as F

from frames import panel, station_series
from hazeline.operators.features import build_features
from hazeline.sources.store import FeatureStore
from hazeline.streaming import jobs


def test_incremental_refresh_equals_one_batch(spark, tmp_path):
    raw = panel(spark, station_series(200, "Lahore"), station_series(200, "Karachi"))
    store = FeatureStore(spark, str(tmp_path / "store"))
    landed = str(tmp_path / "landed")
    cut = F.lit("2024-01-05").cast("timestamp_ntz")
    for part in (raw.where(F.col("datetime") < cut), raw.where(F.col("datetime") >= cut)):
        part.coalesce(1).write.mode("append").parquet(landed)
        stream = spark.readStream.schema(raw.schema).parquet(landed)
        jobs.start_refresh(stream, store, str(tmp_path / "offsets")).awaitTermination()
    columns = ["city", "datetime", "aqi", "aqi_lag_24h", "aqi_roll_mean_24h"]
    frames = [
        df.select(*columns).toPandas().sort_values(["city", "datetime"]).reset_index(drop=True)
        for df in (store.read(), build_features(raw))
    ]
    pd.testing.assert_frame_equal(*frames, check_exact=False)
