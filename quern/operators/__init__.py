"""Search, index, replacement and corpus statistics over DataFrames."""
