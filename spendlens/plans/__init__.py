"""Whole analyses composed from operators."""
