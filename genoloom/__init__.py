"""Comparative genomics as Spark batch jobs: DataFrames in, DataFrames out."""
