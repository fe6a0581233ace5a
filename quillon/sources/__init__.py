"""Tables that scans read: rules, files, manifests, commits, settings."""
