"""Readers and writers for the landed input shapes."""
