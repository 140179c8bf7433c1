"""Detection and reporting operators over DataFrames."""
