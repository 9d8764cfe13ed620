"""Readers of file trees."""
