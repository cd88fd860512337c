"""Schemas of the input index and of the stored graph. Lines are 0-based; replies show them 1-based."""

SCHEMA_VERSION = 2

#: Role bits of an occurrence (fixed values of the index format).
DEFINITION, FORWARD_DEFINITION = 0x1, 0x40

OCCURRENCES = "doc_ord long, doc string, occ_ord long, symbol string, symbol_roles int, line int, enc_start int, enc_end int"
SYMBOL_INFO = "doc_ord long, doc string, sym_ord long, symbol string, display_name string"
RELATIONSHIPS = "doc_ord long, doc string, rel_ord long, src string, dst string, is_implementation boolean"
DOCUMENTS = "doc_ord long, doc string"

FILES = "id long, path string"
SYMBOLS = "id long, symbol string, display_name string, file_id long, line int"
EDGES = "kind string, src_id long, dst_id long, file_id long, line int"
REFS = "symbol_id long, file_id long, line int, enclosing_id long"
SPANS = "file_id long, bucket long, start int, end int, doc_ord long, occ_ord long, symbol_id long"
META = "key string, value string"

CALLS, IMPLEMENTS, INHERITS = "calls", "implements", "inherits"
