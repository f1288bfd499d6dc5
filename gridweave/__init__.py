"""Declarative, typed dataflow over parameter tables, planned and run by Spark."""
