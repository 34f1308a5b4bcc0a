"""A Datalog analytics engine on Spark DataFrames."""
