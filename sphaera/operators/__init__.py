"""DataFrame operators: overlaps, contacts, cells, network, groups, faces."""
