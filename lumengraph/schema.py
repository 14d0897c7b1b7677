"""Schemas of the stored tables. Times are timestamps, versions are rows; `src` and `dst` are an edge's ends."""

CLOCK = "struct<time: bigint, peer_id: string>"
NODE = f"id string, labels array<string>, props string, impact double, embedding array<double>, lang string, valid_from timestamp, valid_to timestamp, caused_by string, expires_at timestamp, clock {CLOCK}"
EDGE = f"id string, src string, dst string, rel string, props string, valid_from timestamp, valid_to timestamp, recorded_at timestamp, superseded_by string, impact double, caused_by string, clock {CLOCK}"
VECTOR = "node_id string, embedding array<float>, lang string, cluster_id bigint"
SUPER_NODE = "snapshot_id bigint, cluster_id bigint, theme string, member_count bigint, impact double, centroid array<double>, timestamp timestamp, drift double"
META_EDGE = "from_cluster bigint, to_cluster bigint, weight bigint"
PEER = "peer_id string, public_key binary"
PROPOSAL = "proposal_id string, id string"
VOTE = "proposal_id string, peer_id string, approve boolean, position bigint"

ENGINE_NAME, SCHEMA_VERSION = "lumengraph", 1
