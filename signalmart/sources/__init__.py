"""Readers and writers of the landed, silver and gold tables."""
