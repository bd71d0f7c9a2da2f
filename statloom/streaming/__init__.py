"""Streaming variants of the mergeable statistics (an extension: the batch operators are the same aggregates)."""
