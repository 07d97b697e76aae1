"""Operators for training-data pipelines; nothing else in geoloom imports this subpackage."""
