"""Subpackage plans of lodevec."""
