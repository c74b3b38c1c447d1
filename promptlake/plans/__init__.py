"""Composite plans: tier attribution, reports, diagnosis."""
