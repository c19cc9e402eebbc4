"""Spark jobs for unstructured meshes, the fields and the sparse matrices that live on them."""
