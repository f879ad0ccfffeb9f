"""Configurations and whole runs."""
