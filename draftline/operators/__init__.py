"""Operators on draft tables; each takes and returns DataFrames."""
