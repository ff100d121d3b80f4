"""Jobs: compositions of operators, Spark ML training and scoring."""
