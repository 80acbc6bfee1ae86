"""Registered queries: each plan wires fixture views to operators."""
