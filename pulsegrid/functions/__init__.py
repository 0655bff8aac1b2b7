"""Functions callable from SQL."""
