"""Operators for preparing training data; each module is one operator and imports no other operator."""
