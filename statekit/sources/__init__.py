"""Readers, writers, file inventories and the tables derived from the driver's data."""
