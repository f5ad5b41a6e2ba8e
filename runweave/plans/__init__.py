"""Query registry, reference SQL and composite plans."""
