"""Stateful streams over frames."""
