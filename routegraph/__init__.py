"""Set-oriented analytics over questionnaire routing graphs, on PySpark DataFrames."""

__version__ = "0.1.0"
