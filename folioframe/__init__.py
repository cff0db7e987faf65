"""Knowledge-corpus preparation, retrieval, evaluation and telemetry on Spark DataFrames."""
