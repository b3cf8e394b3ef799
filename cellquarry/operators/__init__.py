"""Handles and their verbs."""
