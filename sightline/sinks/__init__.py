"""Writers of manifests, label trees, journals and workbooks."""
