"""Operators: each takes DataFrames and returns one, with no work done until it is used."""
