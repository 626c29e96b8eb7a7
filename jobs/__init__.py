"""Runnable jobs over tables of texts. Each module has a function that takes a session, and a command line."""
