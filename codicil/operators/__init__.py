"""Relational operators on containers, sections, payloads and reports."""
