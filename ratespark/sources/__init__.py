"""Readers, writers, the quote store and model artifacts."""
