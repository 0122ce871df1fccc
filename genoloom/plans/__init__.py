"""Named queries: each builds a result from the tables of one folder."""
