"""periodlens: period-comparison reports as Spark DataFrame functions."""

from .params import PERIODS, ReportParams, last_year, period_dim  # noqa: F401

__version__ = "0.1.0"
