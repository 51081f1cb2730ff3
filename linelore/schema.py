"""Schemas of the tables that the engine reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T


def _s(ddl: str) -> T.StructType:  # "name kind, ..."
    return T.StructType([T.StructField(n, _KINDS[t]) for n, t in (x.split() for x in ddl.split(","))])


_KINDS = {"string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "binary": T.BinaryType()}
RECORD = _s(
    "timestamp timestamp,command string,command_fingerprint string,profile string,profile_confidence string,cwd string,session_scope string,duration_ms bigint,exit_code int,"
    "raw_bytes bigint,filtered_bytes bigint,raw_bytes_read bigint,bytes_parsed bigint,bytes_emitted bigint,raw_tokens bigint,filtered_tokens bigint,saved_tokens bigint,savings_pct double,"
    "fallback_used boolean,empty_result boolean,passthrough boolean,verifier_repairs int,verifier_skipped boolean,dedup_ref string,delta_ref string,tee_path string"
)
DEDUP_ENTRY = _s("timestamp timestamp,raw_hash string,artifact_hash string,artifact_path string,command string,command_fingerprint string,cwd string,exit_code int,raw_bytes bigint,truncated boolean,scope string")
TEE_ENTRY = _s("id string,timestamp timestamp,path string,command string,command_fingerprint string,profile string,profile_confidence string,cwd string,exit_code int,duration_ms bigint,raw_bytes bigint,raw_tokens bigint")
