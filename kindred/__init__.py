"""Record linkage and near-match queries on Spark DataFrames."""
