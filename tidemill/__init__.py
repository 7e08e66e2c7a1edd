"""Curation and auditing of large catalogs of semi-structured records, as DataFrame plans."""
