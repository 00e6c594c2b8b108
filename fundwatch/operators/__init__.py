"""Analytic operators. Each one takes and returns DataFrames; thresholds are keywords."""
