"""DataFrame operators: flows, zones, destinations, places, population, movement."""
