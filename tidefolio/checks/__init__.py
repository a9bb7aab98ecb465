"""Every operator run over the test tables, and the SQL it is compared with."""
