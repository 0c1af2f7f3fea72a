"""Sievework: a PySpark engine for auditing text corpora and text classifiers."""
