"""Operators over position-carrying DataFrames."""
