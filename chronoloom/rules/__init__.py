"""Rule bases: what a domain's graph is made of."""
