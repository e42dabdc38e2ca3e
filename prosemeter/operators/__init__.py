"""DataFrame operators: scoring, aggregation, joins and restructuring."""
