"""History features: bucketed prefix form == plain account windows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from riskloom.operators.history import history_features, history_features_by_window
from riskloom.plans import inputs
from tests.conftest import SF_SMALL

COLS = ["transactions_per_user", "velocity_rows5", "v1", "v24", "device_change_flag", "account_age"]


def _compare(a, b):
    ka = {r["txn_id"]: r for r in a.collect()}
    kb = {r["txn_id"]: r for r in b.collect()}
    assert ka.keys() == kb.keys()
    for t in ka:
        for c in COLS:
            assert ka[t][c] == kb[t][c], (t, c)
        assert ka[t]["avg_transaction"] == pytest.approx(kb[t]["avg_transaction"], rel=1e-9)
        assert ka[t]["geo_distance"] == pytest.approx(kb[t]["geo_distance"], rel=1e-9, abs=1e-9)


VEL = {"v1": "1 hour", "v24": "24 hours"}


@pytest.mark.parametrize("bucket", ["1 hour", "7 minutes", "2 days"])
def test_bucketed_equals_windows(spark, bucket):
    t = inputs.transactions(spark, SF_SMALL)
    _compare(history_features(t, velocity=VEL, bucket=bucket), history_features_by_window(t, velocity=VEL))


def test_ties_and_hot_account(spark):
    # one account holds most rows, with equal timestamps (ties) and bursts
    base = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(400):
        acct = 1 if i % 3 else (i % 7) + 2
        ts = base + dt.timedelta(minutes=(i // 4) * 13)  # groups of 4 rows share a timestamp
        rows.append((i, acct, ts, float(100 + i), i % 3, 8.0 + (i % 50) * 0.29, 68.0 + (i % 30) * 0.29))
    df = spark.createDataFrame(rows, "txn_id long, account long, ts timestamp, amount double, "
                                     "device_type_encoded int, latitude double, longitude double")
    for bucket in ("1 hour", "5 minutes"):
        _compare(history_features(df, velocity=VEL, bucket=bucket), history_features_by_window(df, velocity=VEL))


def test_no_future_rows_used(spark):
    t = inputs.transactions(spark, SF_SMALL)
    cut = t.agg(F.expr("percentile_approx(unix_micros(ts), 0.5)")).first()[0]
    early = t.filter(F.unix_micros("ts") <= cut)
    full = history_features(t, velocity=VEL).join(early.select("txn_id"), "txn_id", "left_semi")
    _compare(full, history_features(early, velocity=VEL))


def test_raw_table_features_and_travel_window(spark, scratch):
    from riskloom.operators.features import scalar_features
    from riskloom.operators.validate import apply_defaults, dedup_rows
    from riskloom.sources.adapter import from_raw
    from riskloom.sources.tables import read_raw_transactions

    p = scratch + "/raw.csv"
    with open(p, "w") as f:
        f.write("step,type,amount,nameOrig,oldbalanceOrg,newbalanceOrig,nameDest,oldbalanceDest,newbalanceDest,"
                "isFraud,isFlaggedFraud\n")
        for i, (step, acct, amt) in enumerate([(1, "C1", 100), (2, "C1", 300), (2, "C1", 300), (30, "C1", 50),
                                                (25, "C2", 70000)]):
            f.write(f"{step},PAYMENT,{amt},{acct},1000,900,C9,0,0,0,0\n")
    raw = dedup_rows(read_raw_transactions(spark, p))
    t = from_raw(raw)
    h = history_features(t, velocity={"v24": "24 hours"}, travel_within="2 hours")
    f = scalar_features(apply_defaults(h), "batch")
    rows = sorted(f.collect(), key=lambda r: (r["account"], r["step"]))
    assert [r["transactions_per_user"] for r in rows] == [1, 2, 3, 1]
    assert [r["hour_of_day"] for r in rows] == [1, 2, 6, 1]
    assert [r["v24"] for r in rows] == [1, 2, 1, 1]
    assert [r["avg_transaction"] for r in rows] == [50.0, 100.0, 200.0, 35000.0]
    assert all(r["impossible_travel_flag"] == 0 and r["device_change_flag"] == 0 for r in rows)


def test_heavy_hitter_buckets(spark):
    import datetime as dt
    base = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(600):
        acct = 1 if i % 5 else 2 + i % 3          # account 1 holds 80% of the rows
        ts = base + dt.timedelta(seconds=37 * (i // 2))  # pairs share a timestamp
        rows.append((i, acct, ts, float(10 + i % 17), i % 3, 8.0 + (i % 40) * 0.29, 68.0 + (i % 9) * 0.29))
    df = spark.createDataFrame(rows, "txn_id long, account long, ts timestamp, amount double, "
                                     "device_type_encoded int, latitude double, longitude double")
    got = history_features(df, velocity=VEL, bucket="1 day", hot_rows=100, bucket_rows=25)
    _compare(got, history_features_by_window(df, velocity=VEL))


def test_nulls_do_not_depend_on_the_bucket(spark):
    """Null devices, positions and amounts, one id twice, rows without account or time."""
    base = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(120):
        rows.append((i, i % 4, base + dt.timedelta(minutes=17 * i), None if i % 5 == 0 else float(i), None if i % 3 == 0 else i % 2,
                     None if i % 7 == 0 else 8.0 + i % 9, None if i % 7 == 0 else 70.0 + i % 5))
    df = spark.createDataFrame(rows, SCHEMA)
    want = history_features_by_window(df, velocity=VEL)
    for bucket in ("1 hour", "7 minutes", "2 days"):
        _compare_null(history_features(df, velocity=VEL, bucket=bucket), want)
    odd = [(900, None, base, 1.0, 0, 8.0, 70.0), (901, 1, None, 1.0, 0, 8.0, 70.0), (0, 77, base, 5.0, 0, 8.0, 70.0),
           (0, 77, base + dt.timedelta(hours=1), 5.0, 0, 8.0, 70.0)]
    got = history_features(df.union(spark.createDataFrame(odd, SCHEMA)), velocity=VEL)
    assert got.count() == len(rows) + len(odd)
    assert sorted(r["transactions_per_user"] for r in got.where("account = 77").collect()) == [1, 2]
    assert [r["transactions_per_user"] for r in got.where("account IS NULL OR ts IS NULL").collect()] == [None, None]


SCHEMA = "txn_id long, account long, ts timestamp, amount double, device_type_encoded int, latitude double, longitude double"


def _compare_null(a, b):
    ka, kb = ({r["txn_id"]: r for r in x.collect()} for x in (a, b))
    assert ka.keys() == kb.keys()
    for t in ka:
        assert [ka[t][c] for c in COLS] == [kb[t][c] for c in COLS], t
        for c in ("avg_transaction", "geo_distance"):
            assert ka[t][c] == (None if kb[t][c] is None else pytest.approx(kb[t][c], rel=1e-9, abs=1e-9)), (t, c)
