"""Operators for preparing training data; optional, nothing outside this folder imports it."""
