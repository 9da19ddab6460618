"""Gleanery: set-based analytics over a linked game-world knowledge base, on PySpark."""
