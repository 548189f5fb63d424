"""Registered plans; importing a module registers its queries."""
