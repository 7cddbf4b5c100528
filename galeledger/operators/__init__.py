"""Keyed DataFrame -> DataFrame operators."""
