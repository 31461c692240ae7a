"""priorwise: Spark-native as-of features, forecasting and scoring.

Every public function is a ``DataFrame -> DataFrame`` transformation (or a
small job that writes tables). Keys are parameters: a *period* is the ordered
pair (season, round), an *entity* is the thing being ranked, a *group* is the
team an entity belongs to in a period and a *context* is the place a period
happens at.
"""

from priorwise.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir"]
