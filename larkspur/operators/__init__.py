"""Requests to DataFrames: predicates, reads, embeds, mutations, routines, row security."""
