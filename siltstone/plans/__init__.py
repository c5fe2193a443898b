"""Statements of the dialect that Spark SQL does not parse, as plans."""
