"""Query plans over the driver tables: the query catalogue and end-to-end flows."""
