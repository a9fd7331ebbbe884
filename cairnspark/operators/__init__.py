"""DataFrame operators: search, ranking, fusion, late interaction, quantizers, cell layouts, evaluation."""
