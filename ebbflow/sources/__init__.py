"""Adapters from the driver tables, readers and sinks."""
