"""Composite plans: node graphs and cached phases."""
