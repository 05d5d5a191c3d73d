"""DataFrame to DataFrame operators over tuples, lines, rings, blocks, members and rates."""
