"""Streams of points matched with a table of ranges."""
