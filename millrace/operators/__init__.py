"""DataFrame -> DataFrame operators. All are lazy except `graph.step_depth` and `ordering.unique_names`."""
