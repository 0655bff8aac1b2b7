"""PySpark-native analysis of event rasters, traces and spectra."""
