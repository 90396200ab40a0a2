"""Sizes, layouts and schedules as generated rows."""
