"""Query families over the driver tables. Importing this package fills the registry."""
