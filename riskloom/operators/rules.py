"""Rule engine: a declarative list of (id, condition, weight, reason) Columns.

The score is the sum of fired weights, added in listed order (for bit parity
with a sequential float sum), capped at 1.0.  Reasons keep the listed order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    rule_id: str
    condition: Column
    weight: float
    reason: Column


def _fmt0(c: Column) -> Column:
    # format the already rounded value so both engines agree on ties
    return F.format_string("%.0f", F.round(c, 0))


def default_rules() -> list[Rule]:
    c = F.col
    amount = c("amount")
    # --- Fixed values: thresholds, weights and reason texts of the rule set ----
    r1a = amount > 100000
    return [
        Rule("R1a", r1a, 0.25, F.lit("High transaction amount (>₹1,00,000)")),
        Rule("R1b", ~r1a & (amount > 50000), 0.15, F.lit("Large transaction amount (>₹50,000)")),
        Rule("R2", c("transactions_last_1hr") > 5, 0.2,
             F.concat(F.lit("High velocity: "), c("transactions_last_1hr").cast("string"),
                      F.lit(" transactions in 1hr window"))),
        Rule("R3", c("device_change_flag") == 1, 0.2, F.lit("Recent device change detected")),
        Rule("R4", c("impossible_travel_flag") == 1, 0.3,
             F.concat(F.lit("Impossible travel detected (distance: "), _fmt0(c("geo_distance")), F.lit(" km)"))),
        Rule("R5", c("is_night_flag") == 1, 0.1, F.lit("Transaction during unusual hours (11PM–5AM)")),
        Rule("R6", (c("account_age") < 30) & (amount > 25000), 0.2,
             F.concat(F.lit("New account ("), c("account_age").cast("string"), F.lit(" days) with large transaction"))),
        Rule("R7", c("login_attempts") >= 4, 0.2,
             F.concat(F.lit("Suspicious login pattern ("), c("login_attempts").cast("string"), F.lit(" attempts)"))),
        Rule("R8", c("deviation_from_avg") > c("avg_transaction") * 3, 0.15,
             F.lit("Transaction amount significantly above user average")),
        Rule("R9", (c("QR_flag") == 1) & (c("device_change_flag") == 1), 0.15,
             F.lit("QR code transaction from a new device")),
        Rule("R10", c("balance_ratio") > 0.9, 0.2, F.lit("Transaction drains >90% of account balance")),
    ]
    # ---------------------------------------------------------------------------


RULE_IDS = ["R1a", "R1b", "R2", "R3", "R4", "R5", "R6", "R7", "R8", "R9", "R10"]


def _fired(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False))


def rule_score_col(rules: list[Rule] | None = None, cap: float = 1.0) -> Column:
    rules = rules or default_rules()
    total = F.lit(0.0)
    for r in rules:
        total = total + F.when(_fired(r.condition), F.lit(r.weight)).otherwise(F.lit(0.0))
    return F.least(total, F.lit(cap))


def rule_reasons_col(rules: list[Rule] | None = None) -> Column:
    rules = rules or default_rules()
    arr = F.array(*[F.when(_fired(r.condition), r.reason) for r in rules])
    return F.filter(arr, lambda x: x.isNotNull())


def rule_flags(df: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """One int flag column per rule (``hit_<id>``)."""
    rules = rules or default_rules()
    return df.withColumns({f"hit_{r.rule_id}": _fired(r.condition).cast("int") for r in rules})


def apply_rules(df: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    rules = rules or default_rules()
    return df.withColumns({"rule_score": rule_score_col(rules), "rule_reasons": rule_reasons_col(rules)})


def rule_hits(df: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Rows per rule, as a long table (rule_id, hits); one pass, partial aggregation."""
    rules = rules or default_rules()
    agg = df.agg(*[F.count_if(_fired(r.condition)).alias(r.rule_id) for r in rules])
    stack = ", ".join(f"'{r.rule_id}', `{r.rule_id}`" for r in rules)
    return agg.selectExpr(f"stack({len(rules)}, {stack}) AS (rule_id, hits)")
