"""Presence and share analytics over multi-affiliation corpora, on Spark."""
