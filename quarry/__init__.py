"""quarry — data-mining and ML-analytics operators on Spark DataFrames.

Every operator takes DataFrames and returns DataFrames; heavy work runs on
executors, and only d x d matrices or small fitted models (checked sizes)
ever reach the driver.
"""

from quarry.session import get_session, checkpoint_dir, scratch_path

__all__ = ["get_session", "checkpoint_dir", "scratch_path"]
