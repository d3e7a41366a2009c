"""capshift: capacity-telemetry balancing as Spark DataFrame, SQL and Structured Streaming jobs.

Entry points: ``capshift.plans.balance.BalanceRun`` (one balancing run over all
policies and reports), ``capshift.catalog.QUERIES`` (the named queries), and the
operator modules under ``capshift.operators``.
"""

__version__ = "0.1.0"
