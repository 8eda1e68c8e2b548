"""Subpackage sources of lodevec."""
