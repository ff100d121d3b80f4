"""Business analytics on Spark: cleaning, validation, features, models, drift and advice."""
