"""Relational operators over the code graph and the project memory."""
