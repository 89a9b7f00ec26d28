"""Readers: source trees, advisories, registry dumps, bills of materials, artefacts and event streams."""
