"""Batch and streaming jobs over product catalogs and text corpora, on Spark DataFrames."""
