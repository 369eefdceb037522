"""Operators over sample, interval, check, graph and catalogue tables."""
