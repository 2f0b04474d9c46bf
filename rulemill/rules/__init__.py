"""Rules as data: specs, packs, metadata and the catalog that parses rule text."""
