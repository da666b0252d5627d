"""Split series against a plain computation in pandas, under skew."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesmill.operators.asof import asof_backward, asof_nearest
from seriesmill.operators.history import lag_columns, rolling_columns
from seriesmill.operators.ordered import CELL_COLUMN, carry, split, time_cells, value_cells, with_frames
from seriesmill.plans.datasets import chronological_split

START = pd.Timestamp("2024-01-01")


def series(kind: str, seed: int = 7) -> pd.DataFrame:
    """One hot series and many small ones; times are distinct within a series."""
    rng = np.random.default_rng(seed)
    parts = []
    for key, size in ((1, 600), (2, 90), (3, 5), (4, 1), (None, 200)):
        if kind == "bursts":  # most rows of a series within one minute
            seconds = np.concatenate([rng.choice(50_000, size // 4, replace=False) * 1_000, 10**8 + np.arange(size - size // 4) * 0.05])
        elif kind == "sparse":  # days between rows
            seconds = np.cumsum(rng.integers(3_600, 400_000, size))
        else:
            seconds = rng.choice(2_000_000, size, replace=False)
        parts.append(pd.DataFrame({"key": key, "time": START + pd.to_timedelta(np.sort(seconds), unit="s")}))
    out = pd.concat(parts, ignore_index=True)
    out["key"] = out["key"].astype("Int64")
    out["value"] = rng.normal(50, 20, len(out)).round(3)
    out.loc[rng.random(len(out)) < 0.3, "value"] = np.nan
    return out.sample(frac=1, random_state=seed).reset_index(drop=True)


def to_spark(spark, frame):
    rows = [
        tuple(None if pd.isna(v) else (int(v) if c == "key" else (v.floor("us").to_pydatetime() if c == "time" else float(v)))
              for c, v in zip(frame.columns, row))
        for row in frame.itertuples(index=False)
    ]
    kinds = {"key": "long", "time": "timestamp_ntz"}
    return spark.createDataFrame(rows, ", ".join(f"{c} {kinds.get(c, 'double')}" for c in frame.columns))


def collected(df, order):
    out = df.toPandas()
    return out.sort_values(order, na_position="last").reset_index(drop=True)


@pytest.mark.parametrize("kind", ["even", "bursts", "sparse"])
@pytest.mark.parametrize("keyed", [True, False])
@pytest.mark.parametrize("max_rows", [40, 10_000])
def test_frames(spark, kind, keyed, max_rows):
    data = series(kind)
    if not keyed:
        data = data.drop_duplicates("time")
    keys = ["key"] if keyed else []
    columns = lag_columns("value", "v", [1, 30]) | rolling_columns("value", "v", [5, 30], full=False) | {
        f"full_{k}": f for k, f in rolling_columns("value", "v", [5], full=True).items()
    }
    got = collected(with_frames(to_spark(spark, data), ["time"], keys, columns, look_back=30, max_rows=max_rows), ["key", "time"])
    want = data.sort_values("time")
    grouped = want.groupby("key", dropna=False)["value"] if keyed else None

    def rolled(f):
        return grouped.transform(f) if keyed else f(want["value"])

    want = want.assign(
        v_lag_1h=rolled(lambda s: s.shift(1)), v_lag_30h=rolled(lambda s: s.shift(30)),
        v_rolling_mean_30h=rolled(lambda s: s.rolling(30, min_periods=1).mean()),
        v_rolling_max_5h=rolled(lambda s: s.rolling(5, min_periods=1).max()),
        full_v_rolling_mean_5h=rolled(lambda s: s.rolling(5).mean()),
    ).sort_values(["key", "time"], na_position="last").reset_index(drop=True)
    assert len(got) == len(want)
    for name in ("v_lag_1h", "v_lag_30h", "v_rolling_mean_30h", "v_rolling_max_5h", "full_v_rolling_mean_5h"):
        np.testing.assert_allclose(got[name].astype(float), want[name].astype(float), atol=1e-9, err_msg=name)


@pytest.mark.parametrize("kind", ["even", "bursts", "sparse"])
@pytest.mark.parametrize("backwards", [True, False])
@pytest.mark.parametrize("max_rows", [25, 10_000])
def test_carry(spark, kind, backwards, max_rows):
    data = series(kind)
    columns = {"known": ("last", "value"), "total": ("sum", "value")}
    got = collected(carry(to_spark(spark, data), ["time"], ["key"], columns, backwards=backwards, max_rows=max_rows), ["key", "time"])
    want = data.sort_values("time", ascending=not backwards)
    grouped = want.groupby("key", dropna=False)["value"]
    want = want.assign(
        known=grouped.transform(lambda s: s.ffill()), total=grouped.transform(lambda s: s.fillna(0).cumsum()),
        seen=grouped.transform(lambda s: s.notna().cumsum()),
    ).sort_values(["key", "time"], na_position="last").reset_index(drop=True)
    np.testing.assert_allclose(got["known"].astype(float), want["known"].astype(float))
    np.testing.assert_allclose(got["total"].astype(float).fillna(0), want["total"].astype(float), atol=1e-6)


def test_only_long_series_are_cut(spark):
    data = to_spark(spark, series("even"))
    pieces = split(data, ["key"], time_cells("time"), max_rows=100)
    cut_keys = {r["key"] for r in pieces.table.select("key").distinct().collect()}
    assert cut_keys == {1, None}
    assert split(data, ["key"], time_cells("time"), max_rows=600).table is None


def test_pieces_stay_near_the_limit(spark):
    data = to_spark(spark, series("even"))
    assigned = split(data, [], time_cells("time"), look_back=10, max_rows=50).assign(data)
    sizes = [r["count"] for r in assigned.groupBy("__piece").count().collect()]
    assert len(sizes) > 10 and max(sizes) <= 50 + 10 + 10


def test_large_cells_are_divided(spark):
    """Most rows lie within one minute: that minute is cut into seconds."""
    data = to_spark(spark, series("bursts"))
    pieces = split(data, ["key"], time_cells("time"), look_back=5, max_rows=40)
    assert len(pieces.divided) == 1
    sizes = [r["count"] for r in pieces.assign(data).groupBy("key", "__piece").count().collect()]
    assert max(sizes) <= 40 + 20 + 20 + 5
    assert pieces.mark(data).select(CELL_COLUMN).distinct().count() > 20


def test_value_cells(spark):
    data = series("even").dropna(subset=["value"]).drop_duplicates("value")
    got = collected(
        carry(to_spark(spark, data), ["value"], [], {"total": ("sum", "value")}, cells=value_cells("value", 1.0), max_rows=30),
        ["value"],
    )
    want = data.sort_values("value")["value"].cumsum()
    np.testing.assert_allclose(got["total"], want, atol=1e-6)


@pytest.mark.parametrize("max_rows", [30, 10_000])
def test_asof(spark, max_rows):
    left = series("even", 1)[["key", "time"]].dropna()
    right = series("even", 2).dropna(subset=["key", "value"])
    options = {"keys": ["key"], "columns": ["value"], "matched_time": "at", "max_rows": max_rows}
    l, r = to_spark(spark, left), to_spark(spark, right)
    ls, rs = left.sort_values("time"), right.sort_values("time").assign(at=lambda d: d["time"])
    for name, df in (
        ("backward", asof_backward(l, r, **options)),
        ("nearest", asof_nearest(l, r, tolerance="2 hours", required="value", **options)),
    ):
        got = collected(df, ["key", "time"])
        want = pd.merge_asof(
            ls, rs, on="time", by="key", direction=name, tolerance=pd.Timedelta("2h") if name == "nearest" else None
        )
        if name == "nearest":
            want = want.dropna(subset=["value"])
        want = want.sort_values(["key", "time"]).reset_index(drop=True)
        np.testing.assert_allclose(got["value"].astype(float), want["value"].astype(float), err_msg=name)


def test_nearest_ties_and_tolerance(spark):
    left = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-01 12:00:00' AS time UNION ALL SELECT TIMESTAMP_NTZ '2024-01-01 20:00:00'")
    right = spark.sql("""SELECT * FROM VALUES (TIMESTAMP_NTZ '2024-01-01 11:50:00', 1.0D), (TIMESTAMP_NTZ '2024-01-01 12:10:00', 2.0D),
        (TIMESTAMP_NTZ '2024-01-01 20:30:00', 3.0D) AS r(time, v)""")
    rows = asof_nearest(left, right, columns=["v"]).orderBy("time").collect()
    assert [r.v for r in rows] == [2.0, 3.0]  # equal distance: the later row; 30 minutes are inside
    rows = asof_nearest(left, right, columns=["v"], tolerance="29 minutes", required="v").collect()
    assert [r.v for r in rows] == [2.0]


def test_backward_takes_equal_time_and_age(spark):
    left = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-01 12:00:00' AS time")
    right = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-01 12:00:00' AS time, 5.0D AS v UNION ALL SELECT TIMESTAMP_NTZ '2024-01-01 11:00:00', 4.0D")
    assert asof_backward(left, right, columns=["v"]).first().v == 5.0
    older = right.where(F.col("v") == 4.0)
    assert asof_backward(left, older, columns=["v"], max_age="30 minutes").first().v is None


@pytest.mark.parametrize("n,size", [(10, 0.2), (7, 0.3), (1, 0.2), (100, 0.5)])
def test_chronological_split(spark, n, size):
    df = spark.range(n).selectExpr("id", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, int(id * 7)) AS time")
    train, test = chronological_split(df, size, "time", tie_break=["id"])
    cut = int(n * (1 - size))
    assert sorted(r.id for r in train.collect()) == list(range(cut))
    assert sorted(r.id for r in test.collect()) == list(range(cut, n))
