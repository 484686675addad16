"""Annotated-text analytics expressed as lazy Spark DataFrame functions."""
