"""Binary recordings, manifests and result tables."""
