"""Readers, and stores that are written back."""
