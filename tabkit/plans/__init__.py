"""Two analyses composed of the operators, for tables of a known shape."""
