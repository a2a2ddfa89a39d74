"""Causal analytics on Spark DataFrames: profile, diagnose, estimate and stress-test effects."""
