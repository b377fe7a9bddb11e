"""The registered queries: each applies operators to the tables, with SQL for the same rows where SQL can say it."""
