"""Readers and writers of request logs, code corpora, commit logs and prices."""
