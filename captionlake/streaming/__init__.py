"""The row-wise caption steps on unbounded tables."""
