"""Text rules on streams: the same stateless plan, line by line."""
