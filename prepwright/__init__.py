"""prepwright: data quality, preparation and modelling operators on Spark DataFrames."""
