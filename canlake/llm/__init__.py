"""Operators of a training-data pipeline: ten dealt operators and what they share."""
