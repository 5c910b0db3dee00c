"""Plan construction helpers: lineage cuts and guarded broadcasts."""
