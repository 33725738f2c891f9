"""Encoding, tuning and judging binary classifiers with Spark ML."""
