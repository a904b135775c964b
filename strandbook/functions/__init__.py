"""Scalar functions of the ledger: hashes, hexadecimal and date texts, the list encoding of payloads."""
