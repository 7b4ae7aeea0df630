"""Registered queries and whole runs built from the operators."""
