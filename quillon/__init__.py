"""quillon: hybrid retrieval, evidence analytics and corpus preparation on Spark DataFrames."""
