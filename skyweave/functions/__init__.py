"""Column builders: vectors, poses, geodesy."""
