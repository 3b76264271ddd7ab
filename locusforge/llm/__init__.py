"""Operators of a training-data pipeline: dedup, decontamination, search, scoring and token output."""
