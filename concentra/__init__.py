"""concentra: concentration metrics and hypothesis tests over Spark tables.

Every public function maps DataFrames to DataFrames; nothing collects data
to the driver except bounded summaries (quantile boundaries, one-row test
statistics) that are documented where they occur.
"""

__version__ = "0.1.0"
