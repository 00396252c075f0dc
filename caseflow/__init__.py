"""Outcome-oriented process monitoring on Spark: cases, timed events, labels, features, evaluation."""
