"""Plans made of operators: the primitives and the registered queries."""
