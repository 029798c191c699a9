"""siteval: judging and explaining multi-site classifiers with Spark DataFrames."""
