"""DataFrame operators: queries, joins, reductions, paging."""
