"""Planning helpers shared by the operators."""
