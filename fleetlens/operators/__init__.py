"""Derived metrics, joins, selections, payloads and the table store."""
