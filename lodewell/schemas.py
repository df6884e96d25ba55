"""Schemas of the engine's tables."""

CHUNK = "id string, kind string, name string, source_path string, source string, community_id long"
RAW_CHUNK = "source_path string, ord int, name string, kind string, source string, embed_text string"
NOTE = "id string, text string, tags array<string>, timestamp long, vector array<float>"
VECTOR = "id string, vector array<float>"
FILE = "rel_path string, mtime_ns long, size long"
CACHE = "content_hash string, vector array<float>, created_at long"
EDGE = "src string, dst string, sim double"
COMMUNITY = "id string, community_id long"
