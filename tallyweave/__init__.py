"""Reconciliation of two itemised cost documents, and related data work, as Spark jobs."""
