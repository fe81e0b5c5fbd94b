"""Readers of annotation, ontology, set, sequence and reference files, and writers with provenance."""
