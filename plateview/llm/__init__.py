"""Operators for preparing training data at scale; nothing outside this package imports it."""
