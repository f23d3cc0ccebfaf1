"""Spark jobs for paired-measurement and parameter-sweep tables."""
