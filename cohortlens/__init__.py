"""Point-in-time cohort feature store, leakage audits, model evaluation and risk
ranking, written as Spark DataFrame programs."""

__version__ = "0.1.0"
