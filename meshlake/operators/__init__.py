"""Operators on mesh and field tables: DataFrame in, DataFrame out."""
