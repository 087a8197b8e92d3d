"""Road-network analytics on Spark: DataFrame-first operators for map-data quality."""
