"""Query plans: the SQL gate, projections of the test tables, the catalogue of registered queries."""
