"""Readers and writers of tables, cache bundles and manifests."""
