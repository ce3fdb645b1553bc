"""Frames that keep arriving."""
