"""Writers: delimited text, JSON, ledgers, workbooks."""
