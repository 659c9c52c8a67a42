"""Readers: tables, manifests, listings, instruction files, statistics."""

from trajlake.sources.documents import read_documents, read_entries, with_entry
from trajlake.sources.files import collected, episode_catalog, leaf_folders, listing, metadata, numbered_lines, pruned, saved, sections
from trajlake.sources.manifests import located_lines, located_manifest, read_manifest
from trajlake.sources.tables import episode_frames, episode_lengths, table

__all__ = ["collected", "episode_catalog", "episode_frames", "episode_lengths", "leaf_folders", "listing", "located_lines", "located_manifest", "metadata", "numbered_lines", "pruned", "read_documents", "read_entries", "read_manifest", "saved", "sections", "table", "with_entry"]
