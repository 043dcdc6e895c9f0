"""A documentation retrieval and analytics engine on PySpark."""
