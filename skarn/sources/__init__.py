"""Readers and the input views."""
