"""Planning: the suffix query language, and record and definition queries."""
