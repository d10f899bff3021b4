"""Readers of files, folders and hubs."""
