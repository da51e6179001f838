"""Readers and writers of mesh, field, region and result tables."""
