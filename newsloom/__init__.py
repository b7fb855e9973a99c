"""News analytics on Spark: DataFrame transforms for documents, events, places and rasters."""
