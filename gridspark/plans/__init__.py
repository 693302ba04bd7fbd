"""Compositions: the queries the operators were made for."""
