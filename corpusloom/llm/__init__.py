"""Operators of a training-data pipeline: scoring, extraction, dedup, scans, packing."""
