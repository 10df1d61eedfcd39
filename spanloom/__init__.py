"""spanloom: corpus text mining with measured evidence, on Spark DataFrames."""
from spanloom.session import build_session

__all__ = ["build_session"]
