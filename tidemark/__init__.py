"""Order-saturation analytics on Spark DataFrames."""

from tidemark.config import StudyConfig
from tidemark.plans.study import Study

__all__ = ["Study", "StudyConfig"]
