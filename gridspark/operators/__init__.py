"""Relational operators over cells, tiles, requests and observations."""
