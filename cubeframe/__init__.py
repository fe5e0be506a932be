"""Time-stacked raster and tile-catalog analytics as PySpark DataFrame operators."""
