"""tidegrid: market and operational time series on PySpark DataFrames.

Every operator is a function from DataFrames to DataFrames. Nothing reads the
wall clock: where a rule depends on the current time, ``now`` is an argument.
"""

from tidegrid.checks import DataContractError, ensure_none
from tidegrid.session import build_session, checkpointed

__all__ = ["DataContractError", "build_session", "checkpointed", "ensure_none"]
