"""Curation and evaluation of short-text corpora on Spark DataFrames."""
