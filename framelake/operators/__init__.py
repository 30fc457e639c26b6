"""Relational operators over ordered frame relations."""
