"""Queries over the scored log: newest rows, filter, search, view, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import ledger as L
from riskloom.plans import inputs
from riskloom.plans.catalog import register
from riskloom.plans.sql import base

FILTER_STATUS = "FRAUD"
SEARCH_TEXT, SEARCH_STATUS = "C12", "SUSPICIOUS"

_ROW = ("id, sender_id, receiver_id, amount, fraud_status, risk_score, fraud_probability, "
        "strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') AS created_at")


def _rows(df):
    return df.select("id", "sender_id", "receiver_id", "amount", "fraud_status", "risk_score", "fraud_probability",
                     F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("created_at"))


_NEWEST = "ORDER BY created_at DESC, id DESC LIMIT 100"


@register("history_latest", base(f"SELECT {_ROW} FROM (SELECT * FROM log {_NEWEST})"))
def history_latest(spark, sf_dir):
    return _rows(inputs.stored_log(spark, sf_dir).latest(100))


@register("history_filter", base(f"SELECT {_ROW} FROM (SELECT * FROM log WHERE fraud_status = '{FILTER_STATUS}' {_NEWEST})"))
def history_filter(spark, sf_dir):
    return _rows(inputs.stored_log(spark, sf_dir).latest(100, FILTER_STATUS))


_AMOUNT_TEXT = ("CASE WHEN amount IS NULL OR amount = 0 THEN '' WHEN amount = floor(amount) "
                "THEN CAST(CAST(floor(amount) AS BIGINT) AS VARCHAR) ELSE CAST(amount AS VARCHAR) END")
_q = SEARCH_TEXT.lower()


@register("history_search", base(f"""SELECT {_ROW} FROM (SELECT * FROM log
  WHERE (contains(lower(coalesce(sender_id, '')), '{_q}') OR contains(lower(coalesce(receiver_id, '')), '{_q}')
         OR contains({_AMOUNT_TEXT}, '{_q}'))
    AND fraud_status = '{SEARCH_STATUS}' {_NEWEST})"""))
def history_search(spark, sf_dir):
    return _rows(L.latest(L.search(inputs.stored_log(spark, sf_dir).rows(), SEARCH_TEXT, SEARCH_STATUS)))


SEARCH_AMOUNT = "99"
_DIGITS = "regexp_replace(CAST(CAST(amount AS DECIMAL(38,12)) AS VARCHAR), '\\.?0+$', '')"


@register("history_search_amount", base(f"""SELECT {_ROW} FROM (SELECT * FROM log
  WHERE contains(sender_id, '{SEARCH_AMOUNT}') OR contains(receiver_id, '{SEARCH_AMOUNT}')
     OR (amount <> 0 AND contains({_DIGITS}, '{SEARCH_AMOUNT}')) {_NEWEST})"""))
def history_search_amount(spark, sf_dir):
    """FLT6 on digits: the plain text of the amount holds the searched part."""
    return _rows(L.latest(L.search(inputs.stored_log(spark, sf_dir).rows(), SEARCH_AMOUNT)))


_INR = """'₹' || CASE WHEN amt < 0 THEN '-' ELSE '' END ||
  CASE WHEN length(ip) > 3 THEN reverse(regexp_replace(regexp_replace(reverse(substr(ip, 1, length(ip) - 3)),
       '(\\d\\d)', '\\1,', 'g'), ',$', '')) || ',' || substr(ip, length(ip) - 2, 3) ELSE ip END ||
  CASE WHEN length(fr) > 0 THEN '.' || fr ELSE '' END"""


@register("history_view", base(f"""
, top AS (SELECT * FROM log {_NEWEST})
, f AS (SELECT *, coalesce(amount, 0.0) AS amt,
          split_part(printf('%.3f', round(abs(coalesce(amount, 0.0)), 3)), '.', 1) AS ip,
          regexp_replace(split_part(printf('%.3f', round(abs(coalesce(amount, 0.0)), 3)), '.', 2), '0+$', '') AS fr
        FROM top)
SELECT CAST(row_number() OVER (ORDER BY created_at, id) AS INTEGER) AS ordinal,
  coalesce(sender_id, '—') AS sender, coalesce(receiver_id, '—') AS receiver,
  {_INR} AS amount_text,
  coalesce(fraud_status, 'SAFE') AS status,
  CASE WHEN coalesce(risk_score, 0) >= 60 THEN 'danger' WHEN coalesce(risk_score, 0) >= 30 THEN 'warning' ELSE 'safe' END AS band,
  least(coalesce(risk_score, 0.0), CAST(100 AS DOUBLE)) AS bar_width,
  printf('%.0f', round(coalesce(risk_score, 0.0), 0)) AS risk_text,
  printf('%.1f%%', round(coalesce(fraud_probability, 0.0) * 100, 1)) AS probability_text,
  coalesce(strftime(created_at, '%d %b, %I:%M ') || lower(strftime(created_at, '%p')), '—') AS time_text
FROM f"""))
def history_view(spark, sf_dir):
    return L.history_view(inputs.stored_log(spark, sf_dir).latest(100)).withColumn("ordinal", F.col("ordinal").cast("int"))


@register("history_counts", base(f"""SELECT count(*) AS total, count(*) FILTER (WHERE fraud_status = 'FRAUD') AS fraud,
  count(*) FILTER (WHERE fraud_status = 'SUSPICIOUS') AS suspicious, count(*) FILTER (WHERE fraud_status = 'SAFE') AS safe
FROM (SELECT * FROM log {_NEWEST})"""))
def history_counts(spark, sf_dir):
    return L.status_counts(inputs.stored_log(spark, sf_dir).latest(100))


@register("dashboard_stats", base("""SELECT count(*) AS total_transactions,
  count(*) FILTER (WHERE fraud_status = 'FRAUD') AS fraud_detected,
  count(*) FILTER (WHERE fraud_status = 'SUSPICIOUS') AS suspicious,
  count(*) FILTER (WHERE fraud_status = 'SAFE') AS safe_transactions,
  coalesce(round(CAST(count(*) FILTER (WHERE fraud_status IN ('FRAUD', 'SUSPICIOUS')) AS DOUBLE) / nullif(count(*), 0) * 100, 1), 0.0)
    AS detection_rate,
  coalesce(round(avg(CAST(coalesce(risk_score, 0.0) AS DECIMAL(20,4))), 1), 0.0) AS avg_risk_score
FROM log"""))
def dashboard_stats(spark, sf_dir):
    return inputs.stored_log(spark, sf_dir).dashboard_stats()
