"""Clustering of arriving points."""
