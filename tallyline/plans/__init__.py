"""Driver-side plans: contracts, policies, planning and layered verification."""
