"""Dependency order, runs and reports."""
