"""Column functions: identifiers, parsers, geometry, calendar, movement."""
