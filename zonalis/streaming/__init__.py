"""Streams of visits: windowed counts and occupancy with state."""
