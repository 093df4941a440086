"""Market signal analytics on Spark: DataFrame operators over whole tables."""
