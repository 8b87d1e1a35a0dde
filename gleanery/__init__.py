"""Gleanery: document-corpus analytics expressed as Spark DataFrame plans."""
