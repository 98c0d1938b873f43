"""Named queries: composed plans over the driver's tables, with their SQL."""
