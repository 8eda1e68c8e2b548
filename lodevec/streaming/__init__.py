"""Subpackage streaming of lodevec."""
