"""Named queries over the driver tables and the SQL each must agree with."""
