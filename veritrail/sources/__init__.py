"""Readers: tables, files, archives, manifests, vocabularies and a memo of embeddings."""
