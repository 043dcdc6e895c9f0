"""Query planning on the driver: from a topic to the facets that are executed."""
