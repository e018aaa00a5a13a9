"""Operators for building training data: packing, URL and quality filters, source
mixing, nearest neighbours, secret scans, language-model scores, page text,
near-duplicate joins and fingerprints.  Nothing outside this package imports it."""
