"""Readers and writers: feed documents, transformed records, stored tables."""
