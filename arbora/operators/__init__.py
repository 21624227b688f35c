"""Relational operators over file entries."""
