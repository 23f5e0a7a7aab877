"""The library's operators bound to tables, with the SQL that checks them."""
