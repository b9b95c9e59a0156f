"""Fact analytics on Spark: checks, joins, graphs and reports as DataFrame queries."""
