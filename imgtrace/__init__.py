"""imgtrace: imaging-style time series, masks and corpora as Spark DataFrames."""
