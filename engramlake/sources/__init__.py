"""Readers and writers for the file formats evaluation runs leave behind."""
