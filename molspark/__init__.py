"""Molecule-barcode and lineage-tracing analytics as Spark DataFrame operators."""
