"""Feature table: defaults, scalar features and history features together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions import scalars as S


def scalar_features(df: DataFrame, profile: str = "batch") -> DataFrame:
    """SC1-SC6, SC10, SC11 on a table that already has amount, balances, type,
    hour_of_day and avg_transaction."""
    return df.withColumns({
        "log_amount": S.log_amount("amount"),
        "large_transaction_flag": S.large_flag("amount"),
        "balance_change_org": S.balance_change("oldbalanceOrg", "newbalanceOrig"),
        "balance_change_dest": F.col("newbalanceDest") - F.col("oldbalanceDest"),
        "balance_ratio": S.balance_ratio("amount", "oldbalanceOrg", profile),
        "type_encoded": S.type_code("type", profile),
        # batch derives the flag from the hour; an online payload's flag is taken as sent
        "is_night_flag": S.is_night("hour_of_day") if profile == "batch" else F.col("is_night_flag"),
        "deviation_from_avg": S.deviation("amount", "avg_transaction"),
    })
