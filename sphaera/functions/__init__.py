"""Column functions: geometry, selections, sphere points."""
