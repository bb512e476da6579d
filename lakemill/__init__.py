"""A PySpark analytics engine for star- and snowflake-schema tables."""
