"""shelfwise: demand forecasting and perishable-stock analytics as Spark DataFrame jobs.

Every operator is a function DataFrame -> DataFrame. Batch operators are keyed by
``item`` (or ``dish`` for stock) and ``date``; the only Python-side code is the
three keyed folds (stock ledger, policy back-test, streaming ledger), which run
per key through Arrow batches.
"""

from shelfwise.session import get_session, scratch_path, cut_lineage  # noqa: F401

__all__ = ["get_session", "scratch_path", "cut_lineage"]
