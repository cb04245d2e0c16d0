"""Readers, writers, schemas and the questionnaire seed."""
