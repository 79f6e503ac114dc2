"""riskloom: payment-risk analytics expressed as Spark DataFrame plans.

Sub-packages
------------
sources     declared-schema readers and the events/customer transaction adapter
functions   Column-level scalar helpers (features, formats)
operators   DataFrame -> DataFrame operators (history, rules, scoring, log,
            evaluation, sampling, neighbours, anomaly, models)
streaming   Structured Streaming versions of scoring, state and the log sink
plans       the registered queries and their SQL oracles
"""

__version__ = "0.1.0"
