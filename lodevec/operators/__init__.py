"""Subpackage operators of lodevec."""
