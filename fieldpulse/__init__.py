"""fieldpulse: survey field-monitoring analytics on Spark DataFrames."""

from .params import DEFAULTS, SurveyParams
from .sources.tables import Tables

__all__ = ["DEFAULTS", "SurveyParams", "Tables"]
