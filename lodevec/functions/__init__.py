"""Subpackage functions of lodevec."""
