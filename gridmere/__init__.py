"""gridmere: gridded and geospatial observation analytics on PySpark DataFrames."""
