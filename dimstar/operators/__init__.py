"""Series analytics: operators."""
