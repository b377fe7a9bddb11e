"""Readers and writers: tables, frequency files, pipe tables, embedded JSON, saved rules."""
