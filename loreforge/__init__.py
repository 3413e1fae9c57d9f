"""Corpus, retrieval and learner-analytics operators on PySpark DataFrames."""
