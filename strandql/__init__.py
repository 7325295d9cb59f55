"""Document-style analytics on Spark: pipelines of plain dictionaries compiled to DataFrame plans."""
