"""Aggregate metrics, their mergeable states, and trends over days."""
