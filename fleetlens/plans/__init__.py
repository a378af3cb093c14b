"""Registered queries, their SQL, and ad-hoc SQL."""
