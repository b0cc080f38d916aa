"""Micro-batch runs of the cleansing engine."""
