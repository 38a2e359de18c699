"""The registered queries: each operator over the driver's tables, with SQL that gives the same rows."""
