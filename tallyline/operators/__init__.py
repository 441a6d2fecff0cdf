"""DataFrame operators of reconciliation."""
