"""Views over the test tables, and every operator as a query with an equivalent SQL statement."""
