"""Registered queries over the driver tables with their equivalent SQL."""
