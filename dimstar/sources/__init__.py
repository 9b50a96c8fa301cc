"""Series analytics: sources."""
