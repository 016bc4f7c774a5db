"""Recommender analytics over ratings tables as Spark DataFrame plans."""
