"""Operators of a training-data pipeline, each usable on any table of texts.

Nothing else in the library imports this subpackage.
"""
