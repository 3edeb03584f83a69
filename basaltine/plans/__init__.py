"""Requests: pipelines of operators described as data."""
