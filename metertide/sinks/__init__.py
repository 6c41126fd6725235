"""Sinks: files, tables written once, the message history, SQL databases."""
