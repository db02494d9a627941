"""Row-local Column builders and Arrow kernels."""
