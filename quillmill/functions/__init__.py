"""Subpackage of quillmill."""
