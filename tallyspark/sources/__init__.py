"""Readers and writers of the ledger's outer formats, and the projection of the driver's tables onto the ledger's."""
