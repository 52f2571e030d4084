"""Example selection and attribution analytics on Spark DataFrames."""
