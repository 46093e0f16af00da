"""Delegation analytics on Spark: hostnames, resource records, zones and what they depend on."""
