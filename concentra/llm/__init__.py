"""Operators of a training-data pipeline: cleaning, de-duplication, scoring,
mixing and packing of document tables. Nothing else in the library imports
this subpackage; it may use the library's general helpers."""
