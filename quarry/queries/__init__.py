"""Queries over the fixture tables, by kind of operator."""
