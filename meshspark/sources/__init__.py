"""Where meshes come from."""
