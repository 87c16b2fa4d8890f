"""Vessel-track analytics as ordinary Spark DataFrame and Column functions."""
