"""Registered queries, their oracles and the views they run on."""
