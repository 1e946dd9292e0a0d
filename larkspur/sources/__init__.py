"""Where rows come from: catalogued tables, request bodies, change logs."""
