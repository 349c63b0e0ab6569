"""Narrative text analytics as Spark jobs: every measure is a DataFrame keyed by document."""
