"""End-to-end flows built from the operators, and the registered queries."""
