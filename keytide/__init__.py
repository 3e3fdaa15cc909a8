"""keytide: a versioned key-value changelog engine on Spark DataFrames."""
