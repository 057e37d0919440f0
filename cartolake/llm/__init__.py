"""Operators that prepare training data, each a Spark job over whole tables."""
