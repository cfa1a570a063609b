"""Plan helpers: shared-folder materialisation and versioned merges."""
