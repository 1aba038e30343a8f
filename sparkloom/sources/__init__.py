"""Readers and writers: source trees, archives, logs, catalogs."""
