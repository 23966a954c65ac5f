"""Readers, writers and the mapping of the order-history test tables to the inventory model."""
