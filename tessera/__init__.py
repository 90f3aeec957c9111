"""Quadtree tile-pyramid analytics and training-data operators on Spark DataFrames."""
