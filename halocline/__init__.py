"""Ensemble data assimilation and observation analytics on Spark DataFrames."""
