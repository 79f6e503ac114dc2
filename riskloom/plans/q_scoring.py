"""Queries over the scored transactions: rules, hybrid score, explanations."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import rules as RU
from riskloom.operators import scoring as SC
from riskloom.plans import inputs
from riskloom.plans.catalog import ORACLES, register
from riskloom.operators.logstore import LogStore
from riskloom.streaming.online import online_sink, payload_stream
from riskloom.streaming.scoring import epoch_sink, event_stream, log_sink, score_stream
from riskloom.streaming.state import newest_revision
from riskloom.plans.sql import D, RULES, TXN, _rule_score, base, hist_cte, with_ctes


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@register("rule_score", base("SELECT txn_id, round(rule_score, 4) AS rule_score FROM scored"))
def rule_score(spark, sf_dir):
    f = inputs.features(spark, sf_dir)
    return f.select("txn_id", F.round(RU.rule_score_col(), 4).alias("rule_score"))


@register("rule_hits", base(" UNION ALL ".join(
    f"SELECT '{rid}' AS rule_id, count(*) FILTER (WHERE {cond}) AS hits FROM feat" for rid, cond, _, _ in RULES)))
def rule_hits(spark, sf_dir):
    return RU.rule_hits(inputs.features(spark, sf_dir))


@register("rule_label_matrix", base(" UNION ALL ".join(
    f"SELECT '{rid}' AS rule_id, fraud_label, count(*) FILTER (WHERE {cond}) AS n FROM scored GROUP BY fraud_label"
    for rid, cond, _, _ in RULES)))
def rule_label_matrix(spark, sf_dir):
    s = inputs.scored(spark, sf_dir)
    rules = RU.default_rules()
    per_label = s.groupBy("fraud_label").agg(*[F.count_if(F.coalesce(r.condition, F.lit(False))).alias(r.rule_id)
                                               for r in rules])
    stack = ", ".join(f"'{r.rule_id}', `{r.rule_id}`" for r in rules)
    return per_label.selectExpr("fraud_label", f"stack({len(rules)}, {stack}) AS (rule_id, n)")


HYBRID_COLS = ["txn_id", "ml_probability", "anomaly_score", "rule_score", "fraud_probability", "risk_score",
               "fraud_label"]


@register("hybrid_score", base("""SELECT txn_id, ml_probability, round(anomaly_score, 4) AS anomaly_score,
    round(rule_score, 4) AS rule_score, fraud_probability, risk_score, fraud_label FROM scored"""))
def hybrid_score(spark, sf_dir):
    s = inputs.scored(spark, sf_dir)
    return s.select("txn_id", "ml_probability", F.round("anomaly_score", 4).alias("anomaly_score"),
                    F.round("rule_score", 4).alias("rule_score"), "fraud_probability", "risk_score", "fraud_label")


@register("explain_reasons", base("SELECT txn_id, array_to_string(reasons, ' | ') AS reasons_text FROM scored"))
def explain_reasons(spark, sf_dir):
    return inputs.scored(spark, sf_dir).select("txn_id", F.array_join("reasons", " | ").alias("reasons_text"))


def _sql_template(t: str) -> str:
    pre, rest = t.split("{score}")
    parts = [_q(pre), "CAST(risk_score AS VARCHAR)"]
    if "{reasons}" in rest:
        mid, post = rest.split("{reasons}")
        parts += [_q(mid), "array_to_string(list_transform(reasons, lambda x: '- ' || x), chr(10))", _q(post)]
    else:
        parts.append(_q(rest))
    return " || ".join(parts)


_EXPLAIN_SQL = (f"CASE fraud_label WHEN 'FRAUD' THEN {_sql_template(SC.EXPLAIN_FRAUD)} "
                f"WHEN 'SUSPICIOUS' THEN {_sql_template(SC.EXPLAIN_SUSPICIOUS)} "
                f"ELSE {_sql_template(SC.EXPLAIN_SAFE)} END")
_FOLLOW_SQL = (f"CASE fraud_label WHEN 'FRAUD' THEN {_q(SC.FOLLOW_UPS['FRAUD'])} "
               f"WHEN 'SUSPICIOUS' THEN {_q(SC.FOLLOW_UPS['SUSPICIOUS'])} ELSE {_q(SC.FOLLOW_UPS['SAFE'])} END")
_ACTION_SQL = (f"CASE fraud_label WHEN 'FRAUD' THEN {_q(SC.ACTIONS['FRAUD'])} "
               f"WHEN 'SUSPICIOUS' THEN {_q(SC.ACTIONS['SUSPICIOUS'])} ELSE {_q(SC.ACTIONS['SAFE'])} END")


@register("explain_text", base(
    f"SELECT txn_id, fraud_label, {_EXPLAIN_SQL} AS explanation, {_FOLLOW_SQL} AS follow_up FROM scored"))
def explain_text(spark, sf_dir):
    s = inputs.scored(spark, sf_dir)
    return s.select("txn_id", "fraud_label", SC.explain_text("fraud_label", "risk_score", "reasons").alias("explanation"),
                    SC.follow_up("fraud_label").alias("follow_up"))


@register("score_breakdown", base("""SELECT txn_id, round(ml_probability * 50, 4) AS ml_points,
    round(anomaly_score * 20, 4) AS anomaly_points, round(rule_score * 30, 4) AS rule_points FROM scored"""))
def score_breakdown(spark, sf_dir):
    s = inputs.scored(spark, sf_dir)
    pts = SC.breakdown("ml_probability", "anomaly_score", "rule_score")
    return s.select("txn_id", *[F.round(c, 4).alias(n) for n, c in pts.items()])


@register("risk_band", base(f"""SELECT txn_id, risk_score,
    CASE WHEN risk_score >= 60 THEN 'danger' WHEN risk_score >= 30 THEN 'warning' ELSE 'safe' END AS band,
    least(risk_score, CAST(100 AS DOUBLE)) AS bar_width, {_ACTION_SQL} AS action FROM scored"""))
def risk_band(spark, sf_dir):
    s = inputs.scored(spark, sf_dir)
    return s.select("txn_id", "risk_score", SC.risk_band("risk_score").alias("band"),
                    SC.bar_width("risk_score").alias("bar_width"), SC.action("fraud_label").alias("action"))


@register("stats_hourly", base("""SELECT strftime(date_trunc('hour', created_at), '%Y-%m-%d %H:%M:%S') AS window_start,
    count(*) AS total_transactions,
    count(*) FILTER (WHERE fraud_status = 'FRAUD') AS fraud_detected,
    count(*) FILTER (WHERE fraud_status = 'SUSPICIOUS') AS suspicious,
    count(*) FILTER (WHERE fraud_status = 'SAFE') AS safe_transactions,
    round(avg(CAST(coalesce(risk_score, 0) AS DECIMAL(20,4))), 4) AS avg_risk_score
FROM log GROUP BY 1"""))
def stats_hourly(spark, sf_dir):
    return inputs.stored_log(spark, sf_dir).hourly_stats()


# ---------------------------------------------------------------- scoring with model objects

# A small fixed model, stated as numbers so that SQL can repeat it: scaler, logistic
# coefficients, and an isolation forest of two trees (node: feature, threshold, left, right, size).
MODEL_SCALER = {"log_amount": (9.0, 2.0), "login_attempts": (3.5, 1.7), "geo_distance": (1100.0, 600.0)}
MODEL_COEF, MODEL_INTERCEPT = [1.25, 0.75, 0.5], -1.5
MODEL_TREES = [(0, 0, 0, 0.5, 1, 2, 8), (0, 1, -1, 0.0, -1, -1, 5), (0, 2, 1, 0.25, 3, 4, 3), (0, 3, -1, 0.0, -1, -1, 2), (0, 4, -1, 0.0, -1, -1, 1),
               (1, 0, 2, 0.75, 1, 2, 8), (1, 1, 1, -0.5, 3, 4, 6), (1, 2, -1, 0.0, -1, -1, 2), (1, 3, -1, 0.0, -1, -1, 4), (1, 4, -1, 0.0, -1, -1, 2)]
MODEL_PSI, MODEL_THRESHOLD = 8, 0.55
MODEL_IMPORTANCE = [("login_attempts", 0.4), ("log_amount", 0.35), ("geo_distance", 0.25)]


def fixed_models(spark):
    """The fixed model above as the objects that training makes."""
    import pandas as pd
    from pyspark.ml.classification import LogisticRegressionModel
    from pyspark.ml.linalg import DenseMatrix, Vectors

    from riskloom.operators.anomaly import IsolationForestModel
    from riskloom.operators.hybrid import HybridModels

    java = spark._jvm.org.apache.spark.ml.classification.LogisticRegressionModel
    from pyspark.ml.common import _py2java

    sc = spark.sparkContext
    made = java("fixed", _py2java(sc, DenseMatrix(1, len(MODEL_COEF), MODEL_COEF, True)), _py2java(sc, Vectors.dense([MODEL_INTERCEPT])), 2, False)
    nodes = pd.DataFrame(MODEL_TREES, columns=["tree", "node", "feat", "thr", "left", "right", "size"])
    forest = IsolationForestModel(nodes, list(MODEL_SCALER), MODEL_PSI, MODEL_THRESHOLD)
    return HybridModels(MODEL_SCALER, LogisticRegressionModel(made), forest, MODEL_IMPORTANCE)


def _model_sql() -> str:
    z = {f: f"(({f} - {D(m)}) / {D(s)})" for f, (m, s) in MODEL_SCALER.items()}
    names = list(MODEL_SCALER)
    logit = " + ".join(f"{z[f]} * {D(c)}" for f, c in zip(names, MODEL_COEF)) + f" + {D(MODEL_INTERCEPT)}"
    euler = 0.5772156649015329

    def c(n: int) -> str:
        if n <= 2:
            return D(1 if n == 2 else 0)
        return f"({D(2)} * (ln({D(n - 1)}) + {D(euler)}) - {D(2)} * {D(n - 1)} / {D(n)})"

    def walk(tree: int, node: int, depth: int) -> str:
        _, _, feat, thr, left, right, size = next(r for r in MODEL_TREES if r[:2] == (tree, node))
        if feat < 0:
            return f"({D(depth)} + {c(size)})"
        return f"CASE WHEN {z[names[feat]]} < {D(thr)} THEN {walk(tree, left, depth + 1)} ELSE {walk(tree, right, depth + 1)} END"

    path = f"(({walk(0, 0, 0)}) + ({walk(1, 0, 0)})) / {D(2)}"
    return f"""
, m AS (SELECT * REPLACE ({D(1)} / ({D(1)} + exp(-({logit}))) AS ml_probability,
                          {D(MODEL_THRESHOLD)} - pow({D(2)}, -({path}) / {c(MODEL_PSI)}) AS anomaly_decision) FROM feat)
, mr AS (SELECT *, {_rule_score()} AS rule_score, least(greatest({D(0.5)} - anomaly_decision, {D(0)}), {D(1)}) AS anomaly_score FROM m)
, ms AS (SELECT *, round(least(ml_probability * {D(0.5)} + anomaly_score * {D(0.2)} + rule_score * {D(0.3)}, {D(1)}), 4) AS p FROM mr)
SELECT txn_id, round(ml_probability, 4) AS ml_probability, round(anomaly_score, 4) AS anomaly_score, p AS fraud_probability,
  round(p * 100, 1) AS risk_score, CASE WHEN p >= 0.6 THEN 'FRAUD' WHEN p >= 0.3 THEN 'SUSPICIOUS' ELSE 'SAFE' END AS fraud_label,
  '{MODEL_IMPORTANCE[0][0]}' AS top_feature, {D(MODEL_IMPORTANCE[0][1])} AS top_importance FROM ms"""


@register("hybrid_score_models", with_ctes(TXN, hist_cte(24), body=_model_sql()))
def hybrid_score_models(spark, sf_dir):
    """Main path: features -> scaler -> classifier and isolation forest -> rules ->
    combined score -> prediction record with its importances."""
    from riskloom.operators.hybrid import predictions

    r = predictions(inputs.features(spark, sf_dir), fixed_models(spark)).select("txn_id", "prediction.*")
    top = MODEL_IMPORTANCE[0][0]
    return r.select("txn_id", "ml_probability", "anomaly_score", "fraud_probability", "risk_score", "fraud_label",
                    F.lit(top).alias("top_feature"), F.col("feature_importance")[top].alias("top_importance"))


# ---------------------------------------------------------------- online payloads (JSON)

def online_payloads(spark, sf_dir):
    """One JSON payload per event, as the online path receives them: absent
    fields, numbers as strings, fractions in whole-number fields, and payloads
    whose required amount is absent or not a number."""
    t = inputs.transactions(spark, sf_dir)
    k = F.col("k")

    def field(name, value=None, quoted=False):
        v = (F.col(name) if value is None else value).cast("string")
        return F.concat(F.lit(f'"{name}":"'), v, F.lit('"')) if quoted else F.concat(F.lit(f'"{name}":'), v)

    parts = [
        F.when(k % 25 == 4, F.lit(None)).when(k % 25 == 5, F.lit('"amount":"NaN"'))
        .when(k % 5 == 1, field("amount", quoted=True)).otherwise(field("amount")),
        field("type", quoted=True),
        F.when(k % 4 != 0, field("oldbalanceOrg")),
        F.when(k % 5 == 2, field("login_attempts", quoted=True))
        .when(k % 5 == 3, field("login_attempts", F.col("login_attempts") + F.lit(0.7))).otherwise(field("login_attempts")),
        F.when(k % 5 == 3, F.lit('"account_age":29.7')).when(k % 5 == 4, F.lit('"account_age":null')),
        *[field(c) for c in ("QR_flag", "OTP_flag", "hour_of_day", "device_type_encoded")],
    ]
    return t.select("txn_id", F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*parts)), ","), F.lit("}")).alias("payload"))


@register("online_score", with_ctes(TXN, body=f"""
, p AS (SELECT txn_id, amount, type, login_attempts, QR_flag, CASE WHEN k % 5 = 3 THEN 29 ELSE 365 END AS account_age,
          CASE WHEN k % 4 = 0 THEN amount * 2 ELSE oldbalanceOrg END AS ob FROM txn WHERE k % 25 NOT IN (4, 5))
, f AS (SELECT *, least(amount / greatest(ob, {D(1)}), {D(100)}) AS balance_ratio,
          CAST(CASE type WHEN 'CASH_IN' THEN 0 WHEN 'CASH_OUT' THEN 1 WHEN 'DEBIT' THEN 2 WHEN 'PAYMENT' THEN 3
                         ELSE 4 END AS INTEGER) AS type_encoded,
          round(least(amount / {D(300000)}, {D(1)}), 4) AS ml, round({D(0.4)} - least({D(10)} / {D(3000)}, {D(1)}) * {D(0.6)}, 4) AS dec
        FROM p)
, r AS (SELECT *, least(((((({D(0)} + CASE WHEN amount > 100000 THEN {D(0.25)} ELSE {D(0)} END)
          + CASE WHEN amount <= 100000 AND amount > 50000 THEN {D(0.15)} ELSE {D(0)} END)
          + CASE WHEN account_age < 30 AND amount > 25000 THEN {D(0.2)} ELSE {D(0)} END)
          + CASE WHEN login_attempts >= 4 THEN {D(0.2)} ELSE {D(0)} END)
          + CASE WHEN balance_ratio > 0.9 THEN {D(0.2)} ELSE {D(0)} END), {D(1)}) AS rule_score,
          least(greatest({D(0.5)} - dec, {D(0)}), {D(1)}) AS anomaly FROM f)
, s AS (SELECT *, round(least(ml * {D(0.5)} + anomaly * {D(0.2)} + rule_score * {D(0.3)}, {D(1)}), 4) AS fraud_probability
        FROM r)
SELECT txn_id, type_encoded, round(balance_ratio, 6) AS balance_ratio, round(rule_score, 4) AS rule_score,
  fraud_probability, round(fraud_probability * 100, 1) AS risk_score,
  CASE WHEN fraud_probability >= 0.6 THEN 'FRAUD' WHEN fraud_probability >= 0.3 THEN 'SUSPICIOUS' ELSE 'SAFE' END
    AS fraud_label FROM s"""))
def online_score(spark, sf_dir):
    """SRC4 + D5 + FLT1 + FLT2 + online profile: JSON payloads -> typed fields ->
    rejection of those without a numeric amount -> defaults -> online features ->
    rules -> hybrid score."""
    from riskloom.operators.validate import coerce_online, split_valid

    valid, _ = split_valid(coerce_online(online_payloads(spark, sf_dir)))
    return _online_scored(valid.drop("amount_text"))


def _online_scored(valid):
    from riskloom.operators.features import scalar_features
    from riskloom.operators.validate import apply_defaults
    from riskloom.sources import adapter

    f = scalar_features(apply_defaults(valid), "online")
    f = f.withColumns({"ml_probability": adapter.fixture_ml(F.col("amount")),
                       "anomaly_decision": adapter.fixture_decision(F.col("geo_distance"))})
    s = SC.score(f)
    return s.select("txn_id", "type_encoded", F.round("balance_ratio", 6).alias("balance_ratio"),
                    F.round("rule_score", 4).alias("rule_score"), "fraud_probability", "risk_score", "fraud_label")


@register("online_rejected", with_ctes(TXN, body="""
SELECT txn_id, CASE WHEN k % 25 = 4 THEN 'missing amount' ELSE 'unparsable amount' END AS quarantine_reason
FROM txn WHERE k % 25 IN (4, 5)"""))
def online_rejected(spark, sf_dir):
    """FLT1 on the online path: payloads without a numeric amount, with the reason."""
    from riskloom.operators.validate import coerce_online, split_valid

    _, bad = split_valid(coerce_online(online_payloads(spark, sf_dir)))
    return bad.select("txn_id", "quarantine_reason")


def _online_stream(spark, sf_dir) -> str:
    """The payloads as JSON lines with their id, read as a stream; the folder of its two tables."""
    root = inputs.stream_folder(spark)
    lines = online_payloads(spark, sf_dir).select(F.concat(F.lit('{"txn_id":'), F.col("txn_id").cast("string"), F.lit(","), F.expr("substring(payload, 2)")))
    lines.write.text(f"{root}/in")
    q = (payload_stream(spark, f"{root}/in", max_files=2).writeStream
         .foreachBatch(online_sink(_online_scored, f"{root}/scored", f"{root}/rejected"))
         .option("checkpointLocation", f"{root}/ck").trigger(availableNow=True).start())
    q.awaitTermination()
    return root


@register("online_stream_score", ORACLES["online_score"])
def online_stream_score(spark, sf_dir):
    """SRC4 as a stream: equal to ``online_score``."""
    return spark.read.parquet(f"{_online_stream(spark, sf_dir)}/scored").drop("epoch")


@register("online_stream_rejected", ORACLES["online_rejected"])
def online_stream_rejected(spark, sf_dir):
    """The stream's side table: equal to ``online_rejected``."""
    return spark.read.parquet(f"{_online_stream(spark, sf_dir)}/rejected").select("txn_id", "quarantine_reason")


# ---------------------------------------------------------------- the same scoring as a stream

def _score_replay(spark, sf_dir, sink, very_late: bool):
    """ST1 + ST2: the events as they arrive, out of order, in micro-batches of one query that
    goes on from its checkpoint; per-account state with a delay of an hour."""
    from riskloom.sources.tables import table

    root = inputs.stream_folder(spark)
    customer = table(spark, sf_dir, "customer")

    def go_on():
        feats = score_stream(event_stream(spark, f"{root}/in"), customer, velocity=inputs.RULE_VELOCITY, delay="1 hour")
        feats.writeStream.foreachBatch(sink(root)).option("checkpointLocation", f"{root}/ck").trigger(availableNow=True).start().awaitTermination()

    inputs.replay(spark, sf_dir, f"{root}/in", go_on, very_late)
    return root


@register("stream_scored", base("""SELECT txn_id, ml_probability, round(anomaly_score, 4) AS anomaly_score,
    round(rule_score, 4) AS rule_score, fraud_probability, risk_score, fraud_label FROM scored"""))
def stream_scored(spark, sf_dir):
    """Rows up to an hour out of order; the last revision of each must equal ``hybrid_score``."""
    root = _score_replay(spark, sf_dir, lambda r: epoch_sink(f"{r}/out", f"{r}/late", HYBRID_COLS), very_late=False)
    out = newest_revision(spark.read.parquet(f"{root}/out").drop("epoch"))
    return out.select("txn_id", "ml_probability", F.round("anomaly_score", 4).alias("anomaly_score"),
                      F.round("rule_score", 4).alias("rule_score"), "fraud_probability", "risk_score", "fraud_label")


@register("stream_log", ORACLES["stats_hourly"])
def stream_log(spark, sf_dir):
    """ST3 + ST4: the stream feeds a stored log (appends and amendments); its hourly roll-up."""
    root = _score_replay(spark, sf_dir, lambda r: log_sink(LogStore(spark, f"{r}/log"), f"{r}/late"), very_late=False)
    return LogStore(spark, f"{root}/log").hourly_stats()


@register("stream_late", with_ctes(TXN, body=f""", a AS (SELECT txn_id, account, ts, {inputs.arrival_sql(True)} AS arrival FROM txn)
, b AS (SELECT *, CAST(floor((epoch_us(arrival) - min(epoch_us(arrival)) OVER ()) * {inputs.REPLAY_BATCHES}
      / (max(epoch_us(arrival)) OVER () - min(epoch_us(arrival)) OVER () + 1)) AS INTEGER) AS batch FROM a)
, m AS (SELECT *, max(ts) OVER (PARTITION BY account ORDER BY batch RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM b)
SELECT txn_id, account, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts FROM m WHERE ts < newest - INTERVAL 1 HOUR"""))
def stream_late(spark, sf_dir):
    """ST5: some rows come days late; the late table of the stream."""
    root = _score_replay(spark, sf_dir, lambda r: epoch_sink(f"{r}/out", f"{r}/late", ["txn_id", "fraud_label"]), very_late=True)
    late = spark.read.parquet(f"{root}/late")
    return late.select("txn_id", "account", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))
