"""Views over the driver's tables and the queries that exercise every operator on them."""
