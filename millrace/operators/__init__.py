"""Reusable table operators composed from DataFrame operations."""
