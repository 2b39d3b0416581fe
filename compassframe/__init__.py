"""Table-at-a-time analytics for choosing model configurations, on Spark DataFrames.

Every public function takes DataFrames (or Columns) and returns them lazily. Time, seeds and
thresholds are arguments, so a plan gives the same answer whenever and wherever it is run.
"""
