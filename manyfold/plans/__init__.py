"""Schemas by field id and the planning of a registration."""
