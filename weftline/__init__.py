"""Catalogue, item-set and event analytics as Spark plans."""
