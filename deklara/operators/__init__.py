"""Views, figures, keys, conformance and lint over declared tables."""
