"""Driver-side planning: schemas, specifications, joins and the mapper."""
