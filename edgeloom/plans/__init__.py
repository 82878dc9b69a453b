"""Shared plans: storage, path tables, registered queries."""
