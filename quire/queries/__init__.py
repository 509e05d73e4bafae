"""Registered queries by theme, each with its SQL where SQL can say it."""
