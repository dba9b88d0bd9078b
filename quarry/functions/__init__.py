"""Column builders and UDFs."""
