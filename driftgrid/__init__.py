"""Spatio-textual analytics over moving objects and geotagged text, on PySpark."""
