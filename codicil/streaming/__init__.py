"""Incremental conversion, an extension of the batch plan."""
