"""Training-data operators: fingerprints, personal data, token files, byte BPE, top-k search, packing, toxicity,
set-similarity joins, quality and licence scans. Nothing outside this subpackage imports it."""
