"""Relational operators over objects, chunks, references, uploads and catalogs."""
