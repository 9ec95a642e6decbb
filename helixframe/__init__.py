"""Probabilistic sequence analytics as DataFrame operators."""
