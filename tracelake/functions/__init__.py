"""Column functions over names, paths, routes and identifiers."""
