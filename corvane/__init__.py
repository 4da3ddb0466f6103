"""Corvane: retrieval and retrieval analytics as lazy Spark DataFrame functions."""
