"""Runnable jobs: each module has a command line, a small settings file beside it, and one function that takes a session."""
