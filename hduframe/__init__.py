"""FITS files as Spark tables."""
