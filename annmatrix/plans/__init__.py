"""Plans: the shared scan, and waves under a memory budget."""
