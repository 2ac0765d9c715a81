"""Continuous feeds: the same operators over streams."""
