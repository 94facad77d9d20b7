"""Batch operators. Every function maps DataFrames to DataFrames."""
