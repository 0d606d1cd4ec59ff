"""A document-evidence engine on Spark."""
