"""Keyed state: the same operators over static tables and over streams."""
