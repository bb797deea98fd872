"""Small frames for both Spark and pandas, and comparison of their results."""

import math

import numpy as np
import pandas as pd


def plain(value):
    """One mark for missing values, plain Python numbers."""
    if value is None or value is pd.NaT or value is pd.NA:
        return None
    if isinstance(value, (float, np.floating)):
        return None if math.isnan(value) else round(float(value), 9)
    if isinstance(value, (bool, np.bool_)):
        return bool(value)
    if isinstance(value, (int, np.integer)):
        return float(value)
    if isinstance(value, pd.Timestamp):
        return value.to_pydatetime()
    return value


def rows_of(frame) -> tuple[list[str], list[str]]:
    """Sorted column names and sorted rows of a Spark or pandas frame."""
    if isinstance(frame, pd.DataFrame):
        names = [str(c) for c in frame.columns]
        data = [dict(zip(names, r)) for r in frame.itertuples(index=False, name=None)]
    else:
        names = frame.columns
        data = [dict(zip(names, r)) for r in frame.collect()]
    order = sorted(names)
    return order, sorted(repr([plain(d[n]) for n in order]) for d in data)


def assert_same(spark_frame, pandas_frame):
    assert rows_of(spark_frame) == rows_of(pandas_frame)


def random_frame(seed: int, rows: int = 60) -> pd.DataFrame:
    """Columns of several kinds with gaps and one key that holds a third of the rows."""
    rng = np.random.default_rng(seed)
    key = rng.integers(0, 8, rows).astype(float)
    key[rng.random(rows) < 0.33] = 3
    key[rng.random(rows) < 0.1] = np.nan
    word = rng.choice(np.array(["red", "blue", "green", None], dtype=object), rows)
    price = np.round(rng.random(rows) * 100, 2)
    price[rng.random(rows) < 0.2] = np.nan
    return pd.DataFrame({"id": np.arange(rows), "key": key, "word": word, "price": price,
                         "size": rng.integers(-5, 6, rows)})


SCHEMA = "id bigint, key double, word string, price double, size bigint"


def to_spark(spark, frame: pd.DataFrame, schema: str = SCHEMA):
    """The pandas frame with NaN as null."""
    data = [[None if v is None or (isinstance(v, float) and math.isnan(v)) else v for v in r]
            for r in frame.astype(object).itertuples(index=False, name=None)]
    return spark.createDataFrame(data, schema)
