"""Full-batch graph neural network inference on Spark DataFrames."""
