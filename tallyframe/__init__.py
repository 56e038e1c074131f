"""Exact data profiling as Spark plans."""
