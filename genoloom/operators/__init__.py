"""Relational operators over genes, hits, blocks and documents."""
