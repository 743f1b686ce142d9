"""Readers and writers. Readers list folders recursively and take ids from the path of each file."""
