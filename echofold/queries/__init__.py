"""The reference queries, by theme: each module has QUERIES and the SQL that must agree."""
