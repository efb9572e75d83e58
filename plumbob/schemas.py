"""Schemas of the data model, as DDL."""

DOCUMENT = "doc_id STRING, external_id STRING, vector ARRAY<FLOAT>, metadata STRING, inserted_at TIMESTAMP"
CHANGE = "lsn BIGINT, type STRING, collection_id STRING, doc_id STRING, vector ARRAY<FLOAT>, external_id STRING, metadata STRING, dimension INT, ts TIMESTAMP"
CHANGE_ENTRY = "type STRING, collection_id STRING, doc_id STRING, vector ARRAY<FLOAT>, external_id STRING, metadata STRING, dimension INT, lsn BIGINT, ts TIMESTAMP"
SNAPSHOT = "snapshot_id STRING, collection_id STRING, vector_count BIGINT, dimension INT, created_at TIMESTAMP, size_bytes BIGINT, compression STRING, format STRING"
TENANT = "tenant_id STRING, external_id STRING, name STRING, slug STRING, status STRING, memory_quota_bytes BIGINT, storage_quota_bytes BIGINT, qps_quota INT, metadata STRING, created_at TIMESTAMP, updated_at TIMESTAMP"
DATABASE = "database_id STRING, tenant_id STRING, name STRING, description STRING, state STRING, schema_version INT, created_at TIMESTAMP, updated_at TIMESTAMP"
COLLECTION = "collection_id STRING, database_id STRING, name STRING, dimension INT, metric STRING, embedding_model STRING, max_doc_count BIGINT, created_at TIMESTAMP, updated_at TIMESTAMP"
USER = "user_id STRING, tenant_id STRING, email STRING, password_hash STRING, role STRING, status STRING, created_at TIMESTAMP, updated_at TIMESTAMP, last_login_at TIMESTAMP"
API_KEY = "key_id STRING, tenant_id STRING, key_hash STRING, name STRING, permissions ARRAY<STRING>, created_at TIMESTAMP, expires_at TIMESTAMP, last_used_at TIMESTAMP, created_by STRING"
AUDIT = "audit_log_id STRING, tenant_id STRING, user_id STRING, action STRING, resource_type STRING, resource_id STRING, result STRING, reason STRING, metadata STRING, created_at TIMESTAMP"
TIER_STATE = "collection_id STRING, tier STRING, last_accessed_at TIMESTAMP, access_count BIGINT, access_window_start TIMESTAMP, pinned BOOLEAN, snapshot_id STRING, warm_file_path STRING"
DEAD_LETTER = "id STRING, document_id STRING, collection_id STRING, error_message STRING, retry_count INT, created_at TIMESTAMP, expires_at TIMESTAMP, data STRING"
