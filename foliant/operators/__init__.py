"""DataFrame operators, in the order in which a conversion applies them."""
