"""Sensitive-text analytics as DataFrame operations."""
