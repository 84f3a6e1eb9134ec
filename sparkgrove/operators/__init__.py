"""Analysis, scaling, clustering and classification over feature tables."""
