"""orelens: survey-raster analytics expressed as PySpark DataFrame plans."""
