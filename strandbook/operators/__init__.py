"""Part of the ledger library."""
