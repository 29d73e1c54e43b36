"""The driver's tables seen as a versioned file collection, in Spark and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivia.functions.text import parse_filename, squeeze
from scrivia.operators import chunking
from scrivia.operators.catalog import TYPE_NAMES

TYPES = tuple(TYPE_NAMES)
DOCUMENT = ("id", "doc_id", "revision", "title", "type_prefix", "is_signed", "is_obsolete", "is_empty", "sw_version", "filename", "content_hash", "char_count")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, filename, body): three revisions a document, some signed, obsolete, copied or empty."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    n_ch = docs.agg((F.max("id") / 3).cast("long").alias("top")).select((F.col("top") + 1).alias("n_ch"))
    # one row
    v = docs.crossJoin(F.broadcast(n_ch)).selectExpr("*", "id div 3 AS ch", "id % 3 AS rv", "(id * 31) % n_ch AS tgt", "greatest(3, length(string(n_ch + 9))) AS wd")
    types = "array(" + ",".join(f"'{t}'" for t in TYPES) + ")"
    kind = lambda c: f"element_at({types}, cast({c} % 15 as int) + 1)"
    did = f"concat({kind('ch')}, '-P01-', lpad(string(ch + 10), wd, '0'))"
    title = "concat(regexp_extract(text, '^[A-Za-z]+( [A-Za-z]+){0,3}', 0), if(ch % 4 = 0, concat(' v3.', string(ch % 3), '.0'), ''))"
    status = "if(ch % 11 = 0 or id % 5 = 0, '_Obsolete', if(id % 7 = 0, '-signed', ''))"
    ref = f"concat('See ', {kind('tgt')}, if(id % 11 = 0, '-P00-', '-P01-'), lpad(string(tgt + 10), wd, '0'), ' for details.')"
    return v.selectExpr(
        "id",
        f"concat({did}, ' - ', {title}, '_', chr(65 + rv), {status}, if(id % 50 = 49, '(1)', ''), '.docx') AS filename",
        f"if(id % 17 = 0 or ch % 13 = 0, '', concat(text, '\\n', {ref})) AS body",
    )


def with_copies(fs: DataFrame) -> DataFrame:
    """Adds copies of every 40th file, every other one with a changed body."""
    extra = fs.where("id % 40 = 7").selectExpr(
        "id + 1000000000 AS id", "concat(regexp_replace(filename, '(\\\\(1\\\\))?[.]docx$', ''), '(2).docx') AS filename", "if(id % 80 = 7, body, concat(body, '\\nchanged')) AS body"
    )
    return fs.unionByName(extra)


def items(body: str = "body"):
    """Lines as blocks: every sixth is a heading of level 1 to 3, every fifth of the rest a table."""
    lines = F.split(body, "\n", -1)
    return F.transform(
        lines,
        lambda x, k: F.struct(
            F.when(k % 6 == 0, ((k / 6).cast("int") % 3 + 1)).alias("level"),
            F.when(k % 5 == 0, F.lit("table")).otherwise("text").alias("kind"),
            squeeze(x).alias("text"),
        ),
    )


def packed(fs: DataFrame) -> DataFrame:
    """Parsed files with their chunks, content hash and size."""
    return folded(named(fs))


def named(fs: DataFrame) -> DataFrame:
    return parse_filename(fs).withColumn("revision", F.coalesce("revision", F.lit("")))


def folded(df: DataFrame) -> DataFrame:
    df = df.withColumn("blocks", chunking.section_fold(items())).withColumn("chunks", chunking.chunk_pack("blocks"))
    return df.withColumns(
        {
            "content_hash": chunking.content_hash("chunks"),
            "char_count": chunking.char_count("chunks").cast("long"),
            "is_empty": F.size("chunks") == 0,
        }
    )


def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collection's files with their chunks, deduplicated: names decide which file stays, so only bodies of files that share a name travel."""
    return folded(chunking.first_copies(named(files(spark, sf_dir)).drop("warning")))


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the files' names say, without their bodies."""
    return named(files(spark, sf_dir)).drop("body", "warning")


def tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(documents, chunks) of the collection."""
    rows = kept(spark, sf_dir)
    return rows.select(*DOCUMENT), chunks_of(rows)


def chunks_of(kept: DataFrame) -> DataFrame:
    out = chunking.explode_chunks(kept, "id", "doc_id", "revision")
    return out.withColumn("chunk_id", F.concat("doc_id", F.lit("@"), "revision", F.lit("#"), F.col("position").cast("string")))


_LIST = "[" + ",".join(f"'{t}'" for t in TYPES) + "]"
_BLOCK = "STRUCT(path VARCHAR[], section INTEGER, kind VARCHAR, text VARCHAR)"
_CHUNK = "STRUCT(section_path VARCHAR, section INTEGER, kind VARCHAR, text VARCHAR)"


def _parsed(src: str) -> str:
    return rf"""
  SELECT id, filename, body, is_duplicate, doc_id, split_part(doc_id, '-', 1) AS type_prefix,
    regexp_replace(trim(ltrim(trim(regexp_replace(rest, '_\s*([A-Z])\s*(?:[-_]\s*([A-Za-z]+))?\s*$', '')), '-')), '\s{{2,}}', ' ', 'g') AS title,
    rev AS revision, coalesce(lower(mark) = 'signed', false) AS is_signed, coalesce(lower(mark) = 'obsolete', false) AS is_obsolete,
    CASE WHEN lower(mark) NOT IN ('signed', 'obsolete') THEN 'unknown status suffix ''' || mark || '''' END AS warning
  FROM (SELECT *, nullif(regexp_extract(rest, '_\s*([A-Z])\s*(?:[-_]\s*([A-Za-z]+))?\s*$', 1), '') AS rev,
               nullif(regexp_extract(rest, '_\s*([A-Z])\s*(?:[-_]\s*([A-Za-z]+))?\s*$', 2), '') AS mark
        FROM (SELECT *, substr(stem, length(doc_id) + 1) AS rest
              FROM (SELECT *, nullif(regexp_extract(stem, '^(IFU-MX1|[A-Z0-9]{{2,4}}(?:-[A-Z0-9]+)*?-\d+)', 1), '') AS doc_id
                    FROM (SELECT id, filename, body, regexp_matches(s, '\(\d+\)\s*$') AS is_duplicate, trim(regexp_replace(s, '\(\d+\)\s*$', '')) AS stem
                          FROM (SELECT *, trim(regexp_replace(filename, '\.docx$', '')) AS s FROM {src})))))"""


FILES = f"""
base AS (SELECT doc_id AS id, coalesce(text, '') AS text, doc_id // 3 AS ch, doc_id % 3 AS rv, (SELECT max(doc_id) // 3 + 1 FROM documents) AS n_ch FROM documents),
named AS (SELECT *, (id * 31) % n_ch AS tgt, greatest(3, length(CAST(n_ch + 9 AS VARCHAR))) AS wd FROM base),
files AS (SELECT id,
  {_LIST}[CAST(ch % 15 AS INT) + 1] || '-P01-' || lpad(CAST(ch + 10 AS VARCHAR), CAST(wd AS INT), '0') || ' - '
    || regexp_extract(text, '^[A-Za-z]+( [A-Za-z]+){{0,3}}') || CASE WHEN ch % 4 = 0 THEN ' v3.' || (ch % 3) || '.0' ELSE '' END
    || '_' || chr(CAST(65 + rv AS INT)) || CASE WHEN ch % 11 = 0 OR id % 5 = 0 THEN '_Obsolete' WHEN id % 7 = 0 THEN '-signed' ELSE '' END
    || CASE WHEN id % 50 = 49 THEN '(1)' ELSE '' END || '.docx' AS filename,
  CASE WHEN id % 17 = 0 OR ch % 13 = 0 THEN '' ELSE text || chr(10) || 'See ' || {_LIST}[CAST(tgt % 15 AS INT) + 1]
    || CASE WHEN id % 11 = 0 THEN '-P00-' ELSE '-P01-' END || lpad(CAST(tgt + 10 AS VARCHAR), CAST(wd AS INT), '0') || ' for details.' END AS body
  FROM named),
raw AS ({_parsed('files')}),
parsed AS (SELECT *, nullif(regexp_extract(title, 'v\\d+\\.\\d+(?:\\.\\d+)?(?:-\\w+)?'), '') AS sw_version FROM raw)"""


def _packed(src: str, name: str) -> str:
    return rf"""
lines_{name} AS (SELECT *, list_prepend(
    {{'path': []::VARCHAR[], 'section': 0, 'out': []::{_BLOCK}[], 'level': 0, 'kind': '', 'text': ''}},
    list_transform(string_split(body, chr(10)), lambda x, k: {{'path': []::VARCHAR[], 'section': 0, 'out': []::{_BLOCK}[],
      'level': CAST(CASE WHEN (k - 1) % 6 = 0 THEN 1 + ((k - 1) // 6) % 3 END AS INTEGER),
      'kind': CASE WHEN (k - 1) % 5 = 0 THEN 'table' ELSE 'text' END, 'text': trim(regexp_replace(x, '\s+', ' ', 'g'))}})) AS ls FROM {src}),
folded_{name} AS (SELECT * EXCLUDE (ls), list_reduce(ls, lambda a, x: {{
    'path': CASE WHEN x.level IS NOT NULL AND x.text <> '' THEN list_append(list_slice(a.path, 1, x.level - 1), x.text) ELSE a.path END,
    'section': CASE WHEN x.level IS NOT NULL AND x.text <> '' THEN a.section + 1 ELSE a.section END,
    'out': CASE WHEN x.level IS NULL AND x.text <> '' THEN list_append(a.out, {{'path': a.path, 'section': a.section, 'kind': x.kind, 'text': x.text}}::{_BLOCK}) ELSE a.out END,
    'level': 0, 'kind': '', 'text': ''}}).out AS blocks FROM lines_{name}),
{name} AS (SELECT * REPLACE (coalesce(revision, '') AS revision), array_to_string(list_transform(chunks, lambda c: c.text), chr(10)) AS all_text FROM (
  SELECT *, list_reduce(list_prepend({{'out': []::{_CHUNK}[], 'n': 0, 'b': NULL::{_BLOCK}}},
      list_transform(blocks, lambda b: {{'out': []::{_CHUNK}[], 'n': 0, 'b': b}})), lambda a, x: CASE
    WHEN len(a.out) = 0 OR a.out[-1].section <> x.b.section OR a.n + length(x.b.text) > 2000 THEN
      {{'out': list_append(a.out, {{'section_path': coalesce(nullif(array_to_string(list_transform(x.b.path, lambda p: CASE WHEN length(p) > 80 THEN substr(p, 1, 79) || '…' ELSE p END), ' > '), ''), 'body'),
        'section': x.b.section, 'kind': x.b.kind, 'text': x.b.text}}::{_CHUNK}), 'n': CAST(length(x.b.text) AS INTEGER), 'b': x.b}}
    ELSE {{'out': list_append(list_slice(a.out, 1, len(a.out) - 1), {{'section_path': a.out[-1].section_path, 'section': a.out[-1].section,
        'kind': CASE WHEN a.out[-1].kind = x.b.kind THEN x.b.kind ELSE 'mixed' END, 'text': a.out[-1].text || chr(10) || x.b.text}}::{_CHUNK}),
        'n': CAST(a.n + length(x.b.text) AS INTEGER), 'b': x.b}} END).out AS chunks FROM folded_{name}))"""


PACKED = FILES + "," + _packed("parsed", "packed")
#: docs (documents), chunks; chains and default revisions.
TABLES = (
    PACKED
    + """,
docs AS (SELECT *, sha256(all_text) AS content_hash, CAST(length(all_text) AS BIGINT) AS char_count, len(chunks) = 0 AS is_empty FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, revision ORDER BY is_duplicate, filename) AS rank FROM packed) WHERE rank = 1),
chunk AS (SELECT id, doc_id, revision, title, CAST(u.p - 1 AS INTEGER) AS position, u.c.section_path AS section_path, u.c.kind AS kind, u.c.text AS text,
    doc_id || '@' || revision || '#' || (u.p - 1) AS chunk_id
  FROM docs, (SELECT unnest(chunks) AS c, generate_subscripts(chunks, 1) AS p) u)"""
)
CHAINS = """,
chains AS (SELECT doc_id, min(type_prefix) AS type, CAST(count(*) AS BIGINT) AS n_revisions,
  string_agg(revision, ',' ORDER BY length(revision), revision) AS revisions,
  arg_max(revision, length(revision) || revision) FILTER (WHERE NOT is_obsolete) AS latest_current,
  arg_max(revision, length(revision) || revision) AS latest_any,
  coalesce(arg_max(title, length(revision) || revision) FILTER (WHERE NOT is_obsolete), arg_max(title, length(revision) || revision)) AS title,
  bool_or(is_signed) AS any_signed, bool_and(is_empty) AS all_empty, string_agg(coalesce(sw_version, ''), ',') AS sws FROM docs GROUP BY doc_id),
defaults AS (SELECT doc_id, latest_any AS revision, coalesce(latest_any = latest_current, false) AS is_current FROM chains)"""
