"""Series analytics: plans."""
