"""Delayed-label event-time analytics on Spark."""
