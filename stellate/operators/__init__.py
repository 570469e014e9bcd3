"""Reusable DataFrame operators that hold at scale."""
