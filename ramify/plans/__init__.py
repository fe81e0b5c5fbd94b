"""Recipes of named sets: leaves that read a source, and composites of other recipes."""
