"""How plans are cut, and which candidate strategy a metric and a threshold ask for."""
