"""Operators of a training-data pipeline: each is a DataFrame function of its own module, its query is in ``queries``."""
