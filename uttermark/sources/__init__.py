"""Utterance tables, nested records, page plans and result manifests."""
