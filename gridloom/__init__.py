"""Gridded-data analytics on Spark: DataFrame operators for pixels, features, boxes, graphs and text."""
