"""Readers and writers: messages, postings, crawl history, documents."""
