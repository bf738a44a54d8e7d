"""Readers of visit tables, reference tables and the movement format."""
