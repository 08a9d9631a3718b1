"""Writers of report files, packages and manifests."""
