"""Structured Streaming forms of intake, weekly counts and the ledger."""
