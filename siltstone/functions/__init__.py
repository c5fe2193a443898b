"""Scalar and aggregate functions of the dialect that Spark lacks or defines otherwise."""
