"""Tessera: knowledge-graph and text analytics expressed as PySpark DataFrame programs."""
