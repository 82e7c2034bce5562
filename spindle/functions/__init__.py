"""Spindle subpackage."""
