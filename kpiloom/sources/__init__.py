"""Sources: raw table schemas, the silver adapter, catalog and artifact I/O."""
