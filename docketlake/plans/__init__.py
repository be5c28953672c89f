"""Whole queries composed of operators."""
