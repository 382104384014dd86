"""cachesight: counterfactual cache-replacement supervision on Spark DataFrames."""
