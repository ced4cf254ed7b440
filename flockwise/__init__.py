"""flockwise: a community-interest analytics engine built on PySpark DataFrames."""
