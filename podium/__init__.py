"""Session-feedback analytics on Spark: whole-table operators over DataFrames."""
