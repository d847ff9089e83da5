"""Statements that change tables and their declarations."""
