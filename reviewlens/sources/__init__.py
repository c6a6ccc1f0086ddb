"""Readers and writers, and the binding of the shared test tables to the data model."""
