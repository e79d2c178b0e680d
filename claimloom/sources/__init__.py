"""Readers and writers for the tables the jobs start from and end in."""
