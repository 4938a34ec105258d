"""Large corpora of procedural SQL scripts as Spark tables."""

from scriptloom.operators.audit import (
    assemble,
    audit_partials,
    audit_summary,
    audit_table,
    dedup_chunks,
    keep_partials,
    label_copies,
    map_chunks,
    rule_partials,
    rule_summary,
    rules_of,
    summary_of,
)
from scriptloom.operators.incremental import add_seen, create_seen, extend_seen, only_new, only_new_to
from scriptloom.operators.lines import (
    batch_rows,
    depth_of_lines,
    safe_chunks_of_lines,
    size_runs,
    top_level_of_lines,
)
from scriptloom.operators.lint import (
    annotate,
    findings,
    with_conversion_status,
    with_rule_flags,
    with_verdict,
)
from scriptloom.operators.metadata import (
    line_depth,
    with_block_type,
    with_chunk_id,
    with_counts,
    with_progress,
)
from scriptloom.operators.split import (
    batch_small,
    chunk_scripts,
    rechunk_by_size,
    split_before_begin,
    split_delimiter,
    split_lines,
    split_pattern,
    split_safe,
    split_statements,
    split_top_level,
    structured_chunks,
)
from scriptloom.operators.tables import count_where, lookup, update_if, update_where
from scriptloom.operators.text import (
    drop_blank,
    drop_comment_only,
    normalize_newlines,
    strip_comments,
)
from scriptloom.sources.packs import read_manifest, read_packed_scripts, read_pieces, write_packs
from scriptloom.sources.scripts import read_scripts, scripts_from
from scriptloom.sources.records import record_index
from scriptloom.sources.sinks import (
    read_mapping_csv,
    read_written_scripts,
    write_mapping_csv,
    write_scripts,
)
from scriptloom.streaming.ingest import new_scripts, run_available, stream_chunks, stream_scripts

__all__ = [
    "add_seen",
    "annotate",
    "assemble",
    "audit_partials",
    "audit_summary",
    "audit_table",
    "batch_rows",
    "batch_small",
    "chunk_scripts",
    "count_where",
    "create_seen",
    "dedup_chunks",
    "depth_of_lines",
    "drop_blank",
    "drop_comment_only",
    "extend_seen",
    "findings",
    "keep_partials",
    "label_copies",
    "line_depth",
    "lookup",
    "map_chunks",
    "new_scripts",
    "normalize_newlines",
    "only_new",
    "only_new_to",
    "read_manifest",
    "read_mapping_csv",
    "read_packed_scripts",
    "read_pieces",
    "record_index",
    "read_scripts",
    "read_written_scripts",
    "rechunk_by_size",
    "rule_partials",
    "rule_summary",
    "rules_of",
    "run_available",
    "safe_chunks_of_lines",
    "scripts_from",
    "size_runs",
    "split_before_begin",
    "split_delimiter",
    "split_lines",
    "split_pattern",
    "split_safe",
    "split_statements",
    "split_top_level",
    "stream_chunks",
    "stream_scripts",
    "strip_comments",
    "structured_chunks",
    "summary_of",
    "top_level_of_lines",
    "update_if",
    "update_where",
    "with_block_type",
    "with_chunk_id",
    "with_conversion_status",
    "with_counts",
    "with_progress",
    "with_rule_flags",
    "with_verdict",
    "write_mapping_csv",
    "write_packs",
    "write_scripts",
]
