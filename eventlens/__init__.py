"""Public-event evidence as Spark DataFrames."""
