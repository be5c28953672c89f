"""Operators on DataFrames: postings and matching, ranking, paging, look-ups."""
