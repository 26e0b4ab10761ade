"""facetmill: supervised feature-association analytics on Spark DataFrames."""
