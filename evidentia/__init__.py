"""Evidence analytics on Spark: DataFrame -> DataFrame operators."""
