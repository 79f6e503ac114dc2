"""Hybrid scoring (HY1-HY9): combine classifier, anomaly and rule scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import scalars as S
from riskloom.operators.rules import apply_rules
from riskloom.schemas import FRAUD, SAFE, SUSPICIOUS

# --- Fixed values: weights, thresholds and texts of the scoring contract -------
WEIGHTS = (0.5, 0.2, 0.3)          # ml, anomaly, rules
FRAUD_AT, SUSPICIOUS_AT = 0.6, 0.3
NO_RISK = "No risk factors detected"
ACTIONS = {
    FRAUD: "Transaction blocked — high fraud probability",
    SUSPICIOUS: "Transaction flagged for review",
    SAFE: "Transaction appears safe",
}
FOLLOW_UPS = {
    FRAUD: "Explain why this transaction is fraud and what should be done.",
    SUSPICIOUS: "Why is this transaction flagged as suspicious? What should the user watch out for?",
    SAFE: "This transaction was marked as safe. Can you confirm why and share any UPI safety tips?",
}
EXPLAIN_FRAUD = (
    "## ⚠️ Fraud Analysis\n\nThis transaction has been flagged as **FRAUD** with a risk score of **{score}/100**."
    "\n\n**Key Risk Factors:**\n{reasons}\n\n**Recommendations:**\n1. **Block** this transaction immediately\n"
    "2. **Verify** the sender's identity through an alternate channel\n3. **Report** to your bank's fraud department\n"
    "4. **Freeze** the account if account takeover is suspected\n5. File a complaint at https://cybercrime.gov.in\n\n"
    "**Why this was flagged:** The hybrid detection system combines machine learning predictions, anomaly detection, "
    "and rule-based analysis. Multiple risk signals were triggered simultaneously, indicating a high probability of fraud."
)
EXPLAIN_SUSPICIOUS = (
    "## ⚡ Suspicious Activity\n\nThis transaction is marked **SUSPICIOUS** with a risk score of **{score}/100**."
    "\n\n**Concerns:**\n{reasons}\n\n**Recommendations:**\n1. **Hold** the transaction for manual review\n"
    "2. **Verify** transaction details with the account holder\n3. **Monitor** the account for additional suspicious "
    "activity\n4. Consider implementing additional authentication\n\nWhile not confirmed as fraud, the combination of "
    "risk signals warrants human review."
)
EXPLAIN_SAFE = (
    "## ✅ Transaction Safe\n\nThis transaction appears **SAFE** with a risk score of **{score}/100**.\n\n"
    "No significant risk factors were detected. The transaction follows normal behavioral patterns for this user "
    "profile.\n\n**UPI Safety Tips:**\n- Never share OTP with anyone\n- Verify QR codes before scanning\n"
    "- Use official UPI apps only\n- Enable transaction limits"
)
# -----------------------------------------------------------------------------


def anomaly_score(decision) -> Column:
    """HY1: clip(0.5 - decision, 0, 1)."""
    d = F.col(decision) if isinstance(decision, str) else decision
    return S.clip(F.lit(0.5) - d, 0.0, 1.0)


def combine(ml, anomaly, rule, weights=WEIGHTS) -> Column:
    """HY2: p = round(min(w0*ml + w1*anomaly + w2*rule, 1), 4)."""
    ml, anomaly, rule = (F.col(x) if isinstance(x, str) else x for x in (ml, anomaly, rule))
    raw = ml * F.lit(weights[0]) + anomaly * F.lit(weights[1]) + rule * F.lit(weights[2])
    return F.round(F.least(raw, F.lit(1.0)), 4)


def risk_score(p) -> Column:
    return F.round((F.col(p) if isinstance(p, str) else p) * 100, 1)


def label(p, fraud_at: float = FRAUD_AT, suspicious_at: float = SUSPICIOUS_AT) -> Column:
    p = F.col(p) if isinstance(p, str) else p
    return F.when(p >= fraud_at, F.lit(FRAUD)).when(p >= suspicious_at, F.lit(SUSPICIOUS)).otherwise(F.lit(SAFE))


def reasons(anomaly, ml, rule_reasons) -> Column:
    """HY5: anomaly reason, then ML reason, then rule reasons; fallback text."""
    anomaly, ml, rule_reasons = (F.col(x) if isinstance(x, str) else x for x in (anomaly, ml, rule_reasons))
    head = F.filter(F.array(
        F.when(anomaly > 0.5, F.concat(F.lit("Anomaly detection flags unusual pattern (score: "),
                                       F.format_string("%.2f", F.round(anomaly, 2)), F.lit(")"))),
        F.when(ml > 0.5, F.concat(F.lit("ML model flags high fraud probability ("),
                                  F.format_string("%.1f", F.round(ml * 100, 1)), F.lit("%)"))),
    ), lambda x: x.isNotNull())
    allr = F.concat(head, rule_reasons)
    return F.when(F.size(allr) == 0, F.array(F.lit(NO_RISK))).otherwise(allr)


def score(df: DataFrame, ml: str = "ml_probability", decision: str = "anomaly_decision") -> DataFrame:
    """Rules + HY1-HY5.  ``ml`` is a probability column, ``decision`` an anomaly
    decision value (negative = anomalous)."""
    out = apply_rules(df).withColumn("anomaly_score", anomaly_score(decision))
    out = out.withColumn("fraud_probability", combine(ml, "anomaly_score", "rule_score"))
    return out.withColumns({
        "risk_score": risk_score("fraud_probability"),
        "fraud_label": label("fraud_probability"),
        "reasons": reasons("anomaly_score", ml, "rule_reasons"),
    })


def breakdown(ml, anomaly, rule) -> dict[str, Column]:
    """HY6: score breakdown in points."""
    ml, anomaly, rule = (F.coalesce(F.col(x), F.lit(0.0)) for x in (ml, anomaly, rule))
    return {"ml_points": ml * 50, "anomaly_points": anomaly * 20, "rule_points": rule * 30}


def _by_label(lbl: Column, mapping: dict[str, Column | str]) -> Column:
    def v(x):
        return F.lit(x) if isinstance(x, str) else x
    return F.when(lbl == FRAUD, v(mapping[FRAUD])).when(lbl == SUSPICIOUS, v(mapping[SUSPICIOUS])).otherwise(v(mapping[SAFE]))


def _template(t: str, score_txt: Column, reasons_txt: Column | None) -> Column:
    pre, rest = t.split("{score}")
    if "{reasons}" in rest:
        mid, post = rest.split("{reasons}")
        return F.concat(F.lit(pre), score_txt, F.lit(mid), reasons_txt, F.lit(post))
    return F.concat(F.lit(pre), score_txt, F.lit(rest))


def explain_text(lbl, risk, reasons_arr) -> Column:
    """HY7: per-label explanation with score and bulleted reasons."""
    lbl, risk, reasons_arr = (F.col(x) if isinstance(x, str) else x for x in (lbl, risk, reasons_arr))
    score_txt = risk.cast("string")
    bl = S.bullets(reasons_arr)
    return _by_label(lbl, {
        FRAUD: _template(EXPLAIN_FRAUD, score_txt, bl),
        SUSPICIOUS: _template(EXPLAIN_SUSPICIOUS, score_txt, bl),
        SAFE: _template(EXPLAIN_SAFE, score_txt, None),
    })


def follow_up(lbl) -> Column:
    return _by_label(F.col(lbl) if isinstance(lbl, str) else lbl, FOLLOW_UPS)


def action(lbl) -> Column:
    return _by_label(F.col(lbl) if isinstance(lbl, str) else lbl, ACTIONS)


def risk_band(risk) -> Column:
    """SC23: >=60 danger, >=30 warning, else safe (missing risk counts as 0)."""
    r = F.coalesce(F.col(risk) if isinstance(risk, str) else risk, F.lit(0.0))
    return F.when(r >= 60, F.lit("danger")).when(r >= 30, F.lit("warning")).otherwise(F.lit("safe"))


def bar_width(risk) -> Column:
    return F.least(F.coalesce(F.col(risk) if isinstance(risk, str) else risk, F.lit(0.0)), F.lit(100.0))


def prediction_record(df: DataFrame, importance: list[tuple[str, float]] | None = None, top: int = 8,
                      used: list[str] | None = None) -> DataFrame:
    """SNK5 / D6: one nested record per row.  ``feature_importance`` is the
    global top-``top`` importance map (a bounded literal built once, SC26);
    ``features_used`` maps each feature name to its value."""
    from riskloom.schemas import FEATURE_COLUMNS

    used = used or [*FEATURE_COLUMNS, "balance_change_org", "balance_change_dest", "deviation_from_avg"]
    imp = sorted(importance or [], key=lambda t: -t[1])[:top]
    imp_map = (F.map_from_entries(F.array(*[F.struct(F.lit(k), F.lit(float(v))) for k, v in imp]))
               if imp else F.create_map().cast("map<string,double>"))
    feats = F.map_from_entries(F.array(*[F.struct(F.lit(c), F.col(c).cast("double")) for c in used]))
    rec = F.struct(
        F.col("fraud_probability"), F.col("fraud_label"), F.col("risk_score"), F.col("reasons"),
        F.round("ml_probability", 4).alias("ml_probability"), F.round("anomaly_score", 4).alias("anomaly_score"),
        F.round("rule_score", 4).alias("rule_score"),
        (F.col("ml_probability") > 0.5).cast("int").alias("ml_prediction"),
        imp_map.alias("feature_importance"), feats.alias("features_used"),
    )
    return df.select("txn_id", rec.alias("prediction"))
