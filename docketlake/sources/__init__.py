"""Readers of decision XML and of outlined page text."""
