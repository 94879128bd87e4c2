"""DataFrame operators the census is made of."""
