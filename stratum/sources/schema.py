"""Explicit schemas of the record classes; nothing is inferred."""

COUNTERS = "array<struct<id:decimal(20,0),value:decimal(20,0)>>"
BLOCKS = "array<struct<hash:string,offset:bigint,size:int,blockseq:bigint,inline_data:binary>>"
FILE = f"type string, size bigint, modified_s bigint, modified_ns int, version {COUNTERS}, sequence bigint, blocks {BLOCKS}, deleted boolean, invalid boolean"

TABLES = {
    "files": f"folder string, name string, {FILE}",
    "inbox": f"folder string, epoch bigint, arrival bigint, name string, {FILE}",
    "seqs": "folder string, seq bigint, name string",
    "block_data": "folder string, blockseq bigint, data binary",
    "block_ptrs": "folder string, dir string, hash string, blockseq bigint",
    "block_refs": "folder string, hash string, name string",
    "peers": "folder string, device bigint, max_sequence bigint",
    "folder_meta": "folder string, max_sequence bigint, next_blockseq bigint",
    "folders": "id string, label string, storage_key string, key bigint",
}
#: What a peer announces, as the intake takes it.
UPDATES = f"folder string, name string, arrival bigint, device bigint, {FILE}"
#: Of tables that grow by appended files: the key of a row, and the column whose greatest value is the row that holds.
LATEST = {"files": (["folder", "name"], "sequence"), "seqs": (["folder", "name"], "seq"), "inbox": (["folder", "epoch", "name"], "arrival"), "block_refs": (["folder", "hash", "name"], None)}
