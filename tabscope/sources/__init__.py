"""Scans, landing and run history."""
