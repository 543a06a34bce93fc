"""Sources: archive, sitemaps, manifests, markdown files, event logs."""
