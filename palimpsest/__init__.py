"""Palimpsest: conversation-evidence analytics on Spark DataFrames."""
