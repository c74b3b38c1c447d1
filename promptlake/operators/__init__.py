"""Operators over request, event, queue and experiment tables."""
