"""Model training: linear models from Gram matrices, tree models and the global race from Spark ML."""
