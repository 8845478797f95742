"""Readers, writers, snapshots, views and catalog reports."""
