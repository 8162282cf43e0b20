"""rollframe: Spark-native operators for preparing, scoring, filtering and analysing
language-model rollout tables.

Every public operator is ``DataFrame -> DataFrame`` (or returns a ``Column``), lazy, and
expressed with built-in Spark SQL functions, windows, joins and aggregations so that
Catalyst can prune, push down and plan the work.  Nothing collects rows to the driver.
"""

from rollframe.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
