"""Curation and evaluation of model-generated diagram datasets on Spark DataFrames."""
