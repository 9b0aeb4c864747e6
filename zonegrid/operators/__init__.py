"""Operators on wide origin-destination relations."""
