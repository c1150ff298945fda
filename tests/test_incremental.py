"""Appended days equal the whole table, and two writers never both append a day."""

import datetime as dt

import numpy as np
from frames import frame
from pyspark.sql import functions as F

from ebbflow.operators import recursion as RE
from ebbflow.schema import D, K, TARGETS, FlowConfig
from ebbflow.sources.incremental import IncrementalFeatures

START = dt.date(2024, 1, 1)
CFG = FlowConfig(lag_periods=(1, 3), rolling_windows=(7,), diff_periods=(1,), ewm_alphas=(0.3,), rsi_periods=(7,), bollinger_windows=(14,))


def flows(spark):
    r = np.random.default_rng(2)
    rows = []
    for k, f in enumerate(("a", "b", "late")):
        for n in range(45 + 3 * k):
            if f != "late" or n >= 44:
                rows.append((f, START + dt.timedelta(days=n), float(100 * (k + 1) + r.integers(0, 50)), float(r.integers(0, 90))))
    return frame(spark, rows)


def same(got, want):
    a, b = (x.toPandas().sort_values([K, D]).reset_index(drop=True) for x in (got, want))
    assert list(zip(a[K], a[D])) == list(zip(b[K], b[D]))
    for c in [*TARGETS, *RE.feature_names(cfg=CFG)]:
        assert np.allclose(a[c].astype(float), b[c].astype(float), rtol=1e-7, atol=1e-7, equal_nan=True), c


def test_days_appended_equal_the_whole_table(spark, tmp_path):
    df = flows(spark)
    table = IncrementalFeatures(spark, str(tmp_path / "f"), cfg=CFG)
    assert table.read() is None and not table.covers(df)
    cuts = [START + dt.timedelta(days=n) for n in (43, 45, 60)]
    assert [table.append(df.where(F.col(D) < F.lit(c))) for c in cuts] == [1, 2, 3]
    assert table.covers(df) and table.append(df) == 3 and table.read().count() == df.count()
    same(table.read(), RE.add_model_features(df, cfg=CFG))


def test_two_writers(spark, tmp_path):
    df, path = flows(spark), str(tmp_path / "f")
    first, second = (IncrementalFeatures(spark, path, cfg=CFG) for _ in range(2))
    first.append(df.where(F.col(D) < F.lit(START + dt.timedelta(days=43))))
    days = df.where(F.col(D) < F.lit(START + dt.timedelta(days=44)))
    tried = []
    written = second._written

    def interleaved(rows, state):
        folder = written(rows, state)
        if not tried:  # the other writer commits the same day between this one's work and its commit
            tried.append(first.append(days))
        return folder

    second._written = interleaved
    assert second.append(days) == 2 == tried[0] and first.version() == 2
    assert second.read().count() == days.count() == second.read().select(K, D).distinct().count()


def test_a_failed_attempt_is_not_seen(spark, tmp_path):
    df = flows(spark)
    table = IncrementalFeatures(spark, str(tmp_path / "f"), cfg=CFG)
    table._written(df, None)
    assert table.read() is None and table.version() == 0 and table.append(df.limit(0)) == 0
