"""Sealed document containers, and the operators around them, as Spark DataFrame plans."""
