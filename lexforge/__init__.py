"""Rule-based text analytics as Spark columns and DataFrames."""
