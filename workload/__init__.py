"""The operators at work on the star-schema tables, each next to its SQL twin."""

from workload.registry import ORACLES, QUERIES  # noqa: F401
from workload import relational, statistics, evaluation, modelling, store, sinks  # noqa: F401,E402
