"""Column functions under names of their own in SQL.

They are expressions, so the optimiser sees through them: no Python, no barrier to
pushdown or code generation.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Signature and body of each function; all return null for null.
FUNCTIONS = {
    "seq_complement(s STRING) RETURNS STRING": "translate(s, 'ACGTacgt', 'TGCATGCA')",
    "seq_reverse_complement(s STRING) RETURNS STRING": "reverse(translate(s, 'ACGTacgt', 'TGCATGCA'))",
    "seq_letters(s STRING) RETURNS STRING": r"regexp_replace(s, '[\\s\\d]+', '')",
    "seq_gc_content(s STRING) RETURNS DOUBLE": "(length(s) - length(translate(s, 'GC', ''))) / nullif(length(s), 0)",
    "seq_to_int(s STRING) RETURNS BIGINT": "CAST(conv(concat('0', translate(regexp_replace(upper(s), '[^ACGT]', 'A'), 'ACGT', '0123')), 4, 10) AS BIGINT)",
    "seq_hamming(a STRING, b STRING) RETURNS INT": "CASE WHEN length(a) = length(b) THEN size(filter(zip_with(split(a, ''), split(b, ''), (x, y) -> x <> y), d -> d)) END",
    "seq_words(s STRING, k INT) RETURNS ARRAY<STRING>": "regexp_extract_all(s, concat('(?s)(?=(.{', k, '}))'), 1)",
    "bare_transcript_id(s STRING) RETURNS STRING": r"upper(regexp_replace(s, '^\\s*(?:.*:)?\\s*|\\s*$|\\.\\d+\\s*$', ''))",
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session's SQL; their names."""
    for signature, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    return [s.partition("(")[0] for s in FUNCTIONS]
