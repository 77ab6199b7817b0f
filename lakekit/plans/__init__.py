"""Named queries over the driver tables, their inputs, and the SQL that checks them."""
