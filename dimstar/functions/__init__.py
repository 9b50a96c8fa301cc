"""Series analytics: functions."""
