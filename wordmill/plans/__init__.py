"""Registered queries: importing this package fills the registry."""
