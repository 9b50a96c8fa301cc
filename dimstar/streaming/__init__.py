"""Series analytics: streaming."""
