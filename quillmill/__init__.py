"""Corpus analytics expressed as PySpark DataFrame-to-DataFrame functions."""
