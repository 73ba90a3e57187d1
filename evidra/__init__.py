"""Community-evidence scoring on Spark: every operator takes and returns DataFrames."""
