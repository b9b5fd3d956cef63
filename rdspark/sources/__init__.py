"""Readers: configurations, result logs, manifests, images, raw video, packet streams."""
