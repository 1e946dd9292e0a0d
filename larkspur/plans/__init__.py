"""Requests as data: the query dialect, headers, and what they ask for."""
