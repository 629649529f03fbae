"""Schemas, versioned tables, storage addresses and derived fixtures."""
