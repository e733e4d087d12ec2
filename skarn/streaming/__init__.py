"""Row-wise operators applied to a stream of review files."""
