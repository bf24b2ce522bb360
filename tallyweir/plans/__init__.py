"""Named analyses composed of the operators. Inputs are always explicit tables."""
