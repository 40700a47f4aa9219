"""Corpus comparison on Spark DataFrames: text, vocabulary, vectors, shift candidates."""
