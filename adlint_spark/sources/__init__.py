"""Readers and writers of ad documents, and the shredder that turns them into tables of elements."""
