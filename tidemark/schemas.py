"""Row shapes of the stored tables, as DDL (readers take it as it is)."""

CHUNKS = (
    "container STRING, chunk_id STRING, session_id STRING, chunk_index BIGINT, content STRING, "
    "embedding ARRAY<FLOAT>, date STRING, event_date STRING, metadata MAP<STRING, STRING>"
)
ENTITIES = "container STRING, name STRING, type STRING, summary STRING, n_sessions BIGINT"
RELATIONSHIPS = (
    "container STRING, source STRING, relation STRING, target STRING, date STRING, session_id STRING, ord BIGINT"
)
MESSAGES = "container STRING, session_id STRING, turn BIGINT, role STRING, text STRING, speaker STRING, timestamp STRING"
PHASE_LOG = (
    "run_id STRING, question_id STRING, phase STRING, status STRING, started_at STRING, completed_at STRING, "
    "duration_ms BIGINT, error STRING"
)
