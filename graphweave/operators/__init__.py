"""Operators of one Spark plan: supersteps, numbering, encoding."""
