"""Operators for training-data work. The rest of the library imports nothing from here."""
