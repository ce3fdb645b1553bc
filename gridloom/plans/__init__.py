"""The pixel table, its boundary rules and the ways to run a neighbourhood operation."""
