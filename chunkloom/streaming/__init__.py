"""Streams whose state is a table: each micro-batch folds into the next version of it."""
