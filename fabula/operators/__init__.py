"""Operators from documents to statements, entities, clusters, narratives and graphs."""
