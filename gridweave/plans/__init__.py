"""Whole computations: nodes, edges, hazard overlay, vectors and render-ready tables."""
