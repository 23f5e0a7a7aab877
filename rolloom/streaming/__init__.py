"""Structured Streaming counterparts: queues, running totals, event-time windows and metric sinks."""
