"""Tessera: panel analytics as PySpark DataFrame operators."""
