"""Named plans: every operator as a query over the driver's tables, and the same in SQL."""
