"""Formula trees: typing, simplification, parsing and differentiation."""
