"""Incremental landing of occurrence files."""
