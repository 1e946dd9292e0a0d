"""Corpus preparation for language-model training: ten operators, each with a driver query in `queries`."""
