"""Parsers of raw captures, log and inventory readers, exports, generators and fixture views."""
