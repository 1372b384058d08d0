"""Column expressions: geodesy, planar predicates, polygons."""
