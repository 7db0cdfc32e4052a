"""Interval and expression analytics as plain PySpark DataFrame operators."""
