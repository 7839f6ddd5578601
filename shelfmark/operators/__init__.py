"""Operators over DataFrames: normalize, resolve, enrich, embed, search."""
