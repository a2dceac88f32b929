"""Sales analytics on Spark: irregular sheets to a fact table, views, structured queries."""
