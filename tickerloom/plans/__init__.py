"""Named plans: the registered queries and the flagship scoring plan."""
