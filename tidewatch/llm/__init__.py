"""Operators that prepare training data: quality, deduplication, URL and secret filters,
mixing, tokenising, WARC and HTML extraction.  Nothing else in the library imports this."""
