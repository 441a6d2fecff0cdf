"""Reconciliation and verification of keyed datasets on Spark."""
