"""Operators put together: the batch pipeline, period reports and the query catalogue."""
