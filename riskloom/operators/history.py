"""Per-account history features (W1-W7), skew-safe.

Every feature looks only backward along the account's order ``(ts, txn_id)``.
A plain ``Window.partitionBy(account)`` would put each account in one task, so a
hot account (say a third of all rows) would serialise the whole job.  Instead
rows are cut into ``(account, time bucket)`` groups:

1. inside a bucket, windows give the bucket-local running values (heavy-hitter
   accounts get narrower buckets, so their rows spread over many tasks);
2. a per-(account, bucket) aggregate of the same rows (partial aggregation
   map-side, so only one row per bucket is shuffled) gives each bucket's totals
   and last row, and a window over *buckets* turns them into prefixes;
3. bucket-local values + prefix = the account-wide running value.

Time-range velocity (``RANGE INTERVAL L PRECEDING``) is ``C(t) - C(t - L - 1us)``
where ``C(x)`` = number of the account's rows with ``ts <= x``.  ``C`` at the
shifted instant is read by a *probe* row placed in the bucket of that instant,
so no bucket needs to see any other bucket's rows and no rows are replicated
per window length.  Only a narrow projection is shuffled by bucket; the result
is joined back to the wide input once, on (``txn_id``, account, time).

Rows without an account or a time have no history: they stay, with null
history columns.  Rows that agree in id, account and time count as one
transaction (drop repeated rows first).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.scalars import haversine_km, impossible_travel

_US = 1_000_000
_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def _interval_us(spec: str | int) -> int:
    if isinstance(spec, int):
        return spec * _US
    n, unit = spec.split()
    return int(float(n) * _UNITS[unit.rstrip("s")] * _US)


def bucket_id(t_us: Column, width_us) -> Column:
    w = width_us if isinstance(width_us, Column) else F.lit(width_us)
    return ((t_us - F.pmod(t_us, w)) / w).cast("long")


def history_features(
    txn: DataFrame,
    *,
    velocity: dict[str, str] | None = None,
    bucket: str = "1 day",
    first_avg_factor: float = 0.5,
    avg_floor: float | None = None,
    travel_km: float = 500.0,
    travel_within: str | None = None,
    rows_window: int = 5,
    hot_rows: int = 2_000_000,
    bucket_rows: int = 500_000,
) -> DataFrame:
    """Add W1-W7 to ``txn`` (columns account, txn_id, ts, amount,
    device_type_encoded, latitude, longitude).

    Output columns: transactions_per_user (W7), velocity_rows5 (W1), one column
    per ``velocity`` entry (W2), device_change_flag (W3), prev_latitude,
    prev_longitude, geo_distance, impossible_travel_flag (W4), avg_transaction
    (W5), account_age (W6).
    """
    velocity = velocity or {"transactions_last_1hr": "1 hour"}
    bucket_us = _interval_us(bucket)
    names = list(velocity)

    placed = F.col("account").isNotNull() & F.col("ts").isNotNull()
    narrow = txn.where(placed).select(
        "account", "txn_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t_us"),
        "amount", F.struct(F.col("device_type_encoded").alias("dev"),
                           F.col("latitude").alias("lat"), F.col("longitude").alias("lng")).alias("pos"),
    )
    # one scan: every row yields itself (kind 1) and one probe per velocity window (kind 0)
    legs = [F.struct(F.lit(1).alias("kind"), F.lit(-1).alias("win"), F.col("t_us").alias("t"))]
    for i, name in enumerate(names):
        shift = _interval_us(velocity[name]) + 1  # ts < t - L  <=>  ts <= t - L - 1us
        legs.append(F.struct(F.lit(0).alias("kind"), F.lit(i).alias("win"), (F.col("t_us") - F.lit(shift)).alias("t")))
    # Heavy hitters: accounts with more than ``hot_rows`` rows get their own, narrower
    # bucket width (about ``bucket_rows`` rows per bucket over their time span).  At
    # most total_rows / hot_rows accounts qualify, so this table has a proven bound
    # and is broadcast; every other account keeps the default width.
    hot = (narrow.groupBy("account").agg(F.count(F.lit(1)).alias("_n"), F.min("t_us").alias("_lo"),
                                         F.max("t_us").alias("_hi"))
           .filter(F.col("_n") > hot_rows)
           .select("account", F.least(F.lit(bucket_us), F.greatest(F.lit(_US), F.floor(
               (F.col("_hi") - F.col("_lo") + 1) * F.lit(bucket_rows) / F.col("_n")))).cast("long").alias("_w")))
    narrow = narrow.join(F.broadcast(hot), "account", "left")
    u = narrow.select("account", "txn_id", "amount", "pos", "_w", F.explode(F.array(*legs)).alias("_leg"))
    u = u.select("account", "txn_id", "_w", F.col("_leg.t").alias("t_us"), F.col("_leg.kind").alias("kind"),
                 F.col("_leg.win").alias("win"),
                 F.when(F.col("_leg.kind") == 1, F.col("amount")).alias("amount"),
                 F.when(F.col("_leg.kind") == 1, F.col("pos")).alias("pos"))
    u = u.withColumn("b", bucket_id(F.col("t_us"), F.coalesce(F.col("_w"), F.lit(bucket_us))))

    is_data = F.col("kind") == 1
    rows_w = Window.partitionBy("account", "b").orderBy("t_us", "kind", "txn_id")
    upto = rows_w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = rows_w.rowsBetween(Window.unboundedPreceding, -1)
    peers = Window.partitionBy("account", "b").orderBy("t_us").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    prev = F.last(F.when(is_data, F.struct(F.col("pos.dev").alias("dev"), F.col("pos.lat").alias("lat"),
                                           F.col("pos.lng").alias("lng"), F.col("t_us").alias("t"))),
                  ignorenulls=True).over(before)
    local = u.withColumns({
        "rn_in": F.sum("kind").over(upto),
        "amt_in": F.sum(F.when(is_data, F.col("amount"))).over(before),
        "paid_in": F.count(F.when(is_data, F.col("amount"))).over(before),
        "prev_in": prev,
    }).withColumn("le_in", F.sum("kind").over(peers))

    # Bucket totals straight from the exploded rows (partial aggregation map-side, so
    # only one small row per bucket is shuffled; no second shuffle of the rows).  The
    # bucket's last data row is the max of (t_us, txn_id): an exact tie-break.
    last = F.max(F.when(is_data, F.struct(F.col("t_us").alias("t"), F.col("txn_id").alias("id"),
                                          F.col("pos.dev").alias("dev"), F.col("pos.lat").alias("lat"),
                                          F.col("pos.lng").alias("lng"))))
    per_bucket = u.groupBy("account", "b").agg(
        F.sum("kind").alias("cnt"),
        F.sum(F.when(is_data, F.col("amount"))).alias("amt"),
        F.count(F.when(is_data, F.col("amount"))).alias("paid"),
        last.alias("last"),
        F.min(F.when(is_data, F.col("t_us"))).alias("first_us"),
    )
    acct_w = Window.partitionBy("account").orderBy("b")
    acct_before = acct_w.rowsBetween(Window.unboundedPreceding, -1)
    prefix = per_bucket.select(
        "account", "b",
        F.coalesce(F.sum("cnt").over(acct_before), F.lit(0)).alias("cnt_before"),
        F.sum("amt").over(acct_before).alias("amt_before"),
        F.coalesce(F.sum("paid").over(acct_before), F.lit(0)).alias("paid_before"),
        # the whole last row: its fields must not come from different rows
        F.last("last", ignorenulls=True).over(acct_before).alias("last_before"),
        F.min("first_us").over(Window.partitionBy("account")).alias("first_us_acct"),
    )

    joined = local.join(prefix, ["account", "b"], "inner")
    c_at = F.col("cnt_before") + F.col("le_in")
    has_in = F.col("prev_in").isNotNull()
    # times of data rows; a probe row carries its transaction's time shifted, so it is keyed by the shift undone
    shifts = [0, *(_interval_us(velocity[n]) + 1 for n in names)]
    joined = joined.withColumn("_t", F.col("t_us") + F.element_at(F.array(*[F.lit(x).cast("long") for x in shifts]), F.col("win") + 2))
    # the join back is on the grouping's own columns, so the groups stay where they are; a missing id is one of its own
    def own(df, *names):
        flag = df["txn_id"].isNull()
        return dict(zip(names, (flag, F.when(flag, F.lit(0).cast(df.schema["txn_id"].dataType)).otherwise(df["txn_id"]))))

    joined = joined.withColumns(own(joined, "_no_id", "_txn_id"))
    per_txn = joined.groupBy(F.col("account").alias("_account"), "_no_id", "_txn_id", "_t").agg(
        F.max(F.when(is_data, F.col("cnt_before") + F.col("rn_in"))).alias("transactions_per_user"),
        F.max(F.when(is_data, c_at)).alias("_c_now"),
        F.max(F.when(is_data, F.coalesce(F.col("amt_before"), F.lit(0.0))
                     + F.coalesce(F.col("amt_in"), F.lit(0.0)))).alias("_sum_before"),
        F.max(F.when(is_data, F.col("paid_before") + F.col("paid_in"))).alias("_paid_before"),
        F.max(F.when(is_data, (has_in | F.col("last_before").isNotNull()).cast("int"))).alias("_has_prev"),
        *[F.max(F.when(is_data, F.when(has_in, F.col(f"prev_in.{f}")).otherwise(F.col(f"last_before.{f}"))))
          .alias(f"_prev_{f}") for f in ("dev", "lat", "lng", "t")],
        F.max(F.when(is_data, F.col("first_us_acct"))).alias("_first_us"),
        *[F.max(F.when(F.col("win") == i, c_at)).alias(f"_c_probe{i}") for i in range(len(names))],
    )

    back = txn.withColumns(own(txn, "_is_no_id", "_its_txn_id")).withColumn("_its_t", F.unix_micros(F.col("ts").cast("timestamp")))
    out = back.join(per_txn, (F.col("account") == F.col("_account")) & (F.col("_is_no_id") == F.col("_no_id"))
                    & (F.col("_its_txn_id") == F.col("_txn_id")) & (F.col("_its_t") == F.col("_t")), "left")
    avg = F.when(F.col("_paid_before") > 0, F.col("_sum_before") / F.col("_paid_before")).otherwise(F.col("amount") * F.lit(first_avg_factor))
    if avg_floor is not None:
        avg = F.greatest(avg, F.lit(float(avg_floor)))
    has_prev = F.col("_has_prev") == 1
    prev_lat = F.coalesce(F.col("_prev_lat"), F.col("latitude"))
    prev_lng = F.coalesce(F.col("_prev_lng"), F.col("longitude"))
    known = has_prev & F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    dist = F.coalesce(F.when(known, haversine_km("latitude", "longitude", prev_lat, prev_lng)), F.lit(0.0))
    first_ts = F.timestamp_micros(F.col("_first_us"))
    flag = impossible_travel(dist, travel_km)
    if travel_within is not None:
        # optional time condition: only a jump made within ``travel_within`` counts
        elapsed = F.unix_micros(F.col("ts").cast("timestamp")) - F.col("_prev_t")
        flag = (flag.cast("boolean") & has_prev & (elapsed <= F.lit(_interval_us(travel_within)))).cast("int")
    features = {
        **{name: (F.col("_c_now") - F.col(f"_c_probe{i}")).cast("int") for i, name in enumerate(names)},
        "transactions_per_user": F.col("transactions_per_user").cast("int"),
        "velocity_rows5": F.least(F.col("transactions_per_user"), F.lit(rows_window)).cast("int"),
        "device_change_flag": F.when(has_prev & (F.col("_prev_dev") != F.col("device_type_encoded")), 1)
        .otherwise(0).cast("int"),
        "prev_latitude": prev_lat,
        "prev_longitude": prev_lng,
        "geo_distance": dist,
        "avg_transaction": avg,
        "account_age": F.datediff(F.to_date(F.col("ts").cast("timestamp")), F.to_date(first_ts)).cast("int"),
        "impossible_travel_flag": flag,
    }
    # a row without a place in an account's order has matched nothing
    out = out.withColumns({c: F.when(placed, v) for c, v in features.items()})
    return out.drop("_c_now", "_sum_before", "_paid_before", "_has_prev", "_prev_dev", "_prev_lat", "_prev_lng", "_prev_t",
                    "_first_us", "_account", "_no_id", "_txn_id", "_t", "_is_no_id", "_its_txn_id", "_its_t", *[f"_c_probe{i}" for i in range(len(names))])


def history_features_by_window(txn: DataFrame, *, velocity: dict[str, str] | None = None,
                               first_avg_factor: float = 0.5) -> DataFrame:
    """Reference formulation with plain account windows (one task per account).

    Used by tests as the brute-force check of ``history_features``; not for
    skewed production data.
    """
    velocity = velocity or {"transactions_last_1hr": "1 hour"}
    w = Window.partitionBy("account").orderBy("ts", "txn_id")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    ts = F.col("ts").cast("timestamp")
    out = txn.withColumn("_t", ts)
    for name, spec in velocity.items():
        secs = _interval_us(spec) // _US
        out = out.withColumn(name, F.expr(
            f"count(*) OVER (PARTITION BY account ORDER BY _t "
            f"RANGE BETWEEN INTERVAL {secs} SECONDS PRECEDING AND CURRENT ROW)").cast("int"))
    prev = F.lag(F.struct("device_type_encoded", "latitude", "longitude")).over(w)
    out = out.withColumns({
        "transactions_per_user": F.row_number().over(w).cast("int"),
        "_prev": prev,
        "avg_transaction": F.coalesce(F.avg("amount").over(before), F.col("amount") * F.lit(first_avg_factor)),
        "account_age": F.datediff(F.to_date("_t"), F.to_date(F.min("_t").over(Window.partitionBy("account")))),
    })
    has_prev = F.col("_prev").isNotNull()
    return out.withColumns({
        "velocity_rows5": F.least(F.col("transactions_per_user"), F.lit(5)),
        "device_change_flag": F.when(has_prev & (F.col("_prev.device_type_encoded") != F.col("device_type_encoded")), 1).otherwise(0),
        "geo_distance": F.when(has_prev & F.col("latitude").isNotNull() & F.col("longitude").isNotNull() & F.col("_prev.latitude").isNotNull()
                               & F.col("_prev.longitude").isNotNull(),
                               haversine_km("latitude", "longitude", "_prev.latitude", "_prev.longitude")).otherwise(0.0),
    }).drop("_prev", "_t")
