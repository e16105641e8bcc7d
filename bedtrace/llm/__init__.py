"""Operators for the preparation of training data. Nothing outside this folder imports it."""
