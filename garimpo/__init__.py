"""A web-page search and analytics engine on PySpark."""
