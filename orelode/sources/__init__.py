"""Readers and writers of the formats the operators take and give."""
