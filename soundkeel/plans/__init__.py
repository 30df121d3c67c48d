"""Reusable plan shapes: ordered scans, neighbour chunks, range joins."""
