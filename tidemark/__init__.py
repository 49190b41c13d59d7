"""Market-event analytics on Spark: bars, windows, detectors, outcomes and research gates as DataFrames."""
