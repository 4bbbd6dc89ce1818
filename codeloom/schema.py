"""Explicit schemas of the logical relations; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

STRINGS = T.ArrayType(T.StringType())

STRUCTURE = T.StructType([
    T.StructField("functions", STRINGS), T.StructField("classes", STRINGS), T.StructField("imports", STRINGS), T.StructField("exports", STRINGS),
    T.StructField("calls", T.MapType(T.StringType(), STRINGS)),
])


def _of(text: str) -> T.StructType:
    return T._parse_datatype_string(text)  # needs an active session


def schema(name: str) -> T.StructType:
    """Schema of a relation by name; see RELATIONS for the list."""
    return _of(RELATIONS[name])


RELATIONS = {
    "files": "path string, abs_path string, ext string, tokens int, content string, ord long",
    "modules": "path string, abs_path string, ext string, tokens int, content string, ord long, content_hash string, structure struct<functions:array<string>,classes:array<string>,imports:array<string>,exports:array<string>,calls:map<string,array<string>>>",
    "graph_nodes": "id int, path string, name string, `group` string, depth int, tokens int, functions array<string>, classes array<string>, imports array<string>, complexity int",
    "graph_links": "source int, target int, bidirectional boolean",
    "graph": "nodes array<struct<id:int,path:string,name:string,`group`:string,depth:int,tokens:int,functions:array<string>,classes:array<string>,imports:array<string>,complexity:int>>, links array<struct<source:int,target:int,bidirectional:boolean>>",
    "reports": "batch_id int, files array<string>, analysis string",
    "context_index": "files array<struct<path:string,tokens:int,functions:array<string>,classes:array<string>,imports:array<string>,snippet:string>>",
    "embed_index": "path string, ext string, tokens int, analysis string, structure struct<functions:array<string>,classes:array<string>,imports:array<string>,exports:array<string>,calls:map<string,array<string>>>",
    "vector_documents": "id string, document string, path string, ext string, tokens int, complexity int, functions string, classes string, embedding array<float>",
    "snapshot": "timestamp string, files array<string>, links array<array<string>>",
    "file_cache": "file_path string, content_hash string, tokens int, structure string, analysis string",
    "model_cooldowns": "model string, cool_until timestamp",
    "run_metadata": "key string, value string",
    "usage": "model string, ts timestamp, kind string, n long",
    "model_limits": "model string, rpm int, tpm int, rpd int, tpd int",
    "jobs": "job_id string, status string, url string, outputs array<struct<name:string,label:string>>, error string, step int, step_label string, created_at timestamp",
    "dead_code": "kind string, symbol string, path string",
    "test_gaps": "path string, fn string, status string",
    "impact": "path string, depth int, direct boolean, tokens int, complexity int",
    "security_findings": "file string, severity string, issue string, code string, fix string, tool string",
}
