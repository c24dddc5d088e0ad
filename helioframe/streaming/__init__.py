"""Row-local operators applied to streaming feeds."""
