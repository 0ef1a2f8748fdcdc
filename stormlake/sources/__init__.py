"""Readers of landed bulletins, feeds, archives and document tables."""
