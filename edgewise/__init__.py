"""Pair-graph analytics on Spark: DataFrame-to-DataFrame operators."""
