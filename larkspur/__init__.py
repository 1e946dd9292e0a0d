"""A data API engine on Spark: a URL query dialect, GraphQL, routines, mutations and change feeds, all compiled to DataFrames."""
