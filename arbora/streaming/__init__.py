"""Criteria and events as streams."""
