"""Relational operators over chunks, sections, candidates and traces."""
