"""Plan helpers: shared scratch tables, lineage cuts, size-checked broadcasts."""
