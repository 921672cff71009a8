"""Readers and writers of book archives and page markup."""
