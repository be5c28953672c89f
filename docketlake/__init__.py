"""Docketlake: retrieval and analytics over large document collections, on Spark DataFrames."""
