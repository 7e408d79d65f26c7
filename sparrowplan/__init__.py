"""A relational plan engine on Spark: JSON operator plans run as DataFrames."""
