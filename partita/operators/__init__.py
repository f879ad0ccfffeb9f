"""Matrix algebra, factorisation, inverted lists, search and evaluation."""
