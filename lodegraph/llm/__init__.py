"""Operators for model training data; nothing outside this folder imports it."""
