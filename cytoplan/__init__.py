"""Spatial cell-graph analytics as DataFrame plans."""
