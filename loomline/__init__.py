"""Transcript analytics as Spark plans."""
