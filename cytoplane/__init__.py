"""Spatial-transcriptomics tables on Spark: scans, counts, spatial joins, rasters and annotation checks."""

__version__ = "0.1.0"
