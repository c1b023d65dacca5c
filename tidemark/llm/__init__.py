"""Operators of a training-data pipeline: formatting, de-duplication, scoring, extraction."""
