"""Pipelines: extract, transform, load, alert. Each is a few operators and one write."""
