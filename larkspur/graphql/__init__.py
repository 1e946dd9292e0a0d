"""A GraphQL front over the same plans."""
