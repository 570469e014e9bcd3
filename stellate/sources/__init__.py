"""Readers, landing contracts and publishing."""
