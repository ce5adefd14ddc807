"""Prefix-cache analytics on Spark: content-addressed identities, lookup, routing, replay and tiering as DataFrame plans."""
