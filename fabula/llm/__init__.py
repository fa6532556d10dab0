"""Operators for preparing large text corpora: filtering, deduplication, decontamination,
extraction, tokenising and sharding.  Nothing outside this subpackage imports it."""
