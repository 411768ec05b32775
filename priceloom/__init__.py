"""Price analytics on Spark: mart building, client features, bounds, models and quotes."""
