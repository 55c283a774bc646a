"""polysafe — multilingual safety-evaluation analytics as Spark DataFrame jobs.

Every public function takes and returns Spark DataFrames (or Columns) so that
it composes with ``DataFrame.transform`` and leaves planning to Catalyst.
"""

from polysafe.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
