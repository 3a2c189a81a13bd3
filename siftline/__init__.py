"""Candidate and job screening on Spark, and a training-data toolkit."""
