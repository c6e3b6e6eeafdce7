"""Readers of shards, documents and exports, and writers."""
