"""Report queries, their parameters and their SQL counterparts."""
