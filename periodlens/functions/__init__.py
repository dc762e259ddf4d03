"""Column-expression helpers (pure ``pyspark.sql.functions`` compositions)."""

from . import dates, labels, numeric, slots  # noqa: F401
