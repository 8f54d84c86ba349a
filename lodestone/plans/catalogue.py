"""Registry of the engine's own queries: (spark, sf_dir) -> DataFrame, and DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import paths
from lodestone.functions.snippet import snippets
from lodestone.functions.text import document_reference, iso_time, norm
from lodestone.operators import candidates, classify, maintain, passages, search, stats
from lodestone.plans import context
from lodestone.sources import corpus, samples
from lodestone.sources.parsers import parse_column
from lodestone.sources.tables import stored
from lodestone.streaming import live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_SPACE = "E' \\t\\n\\x0b\\x0c\\r'"
_DOCS = """d AS (SELECT doc_id + 1 AS id, '/corpus' AS root_path, ['.txt', '.adoc', '.java', '.sql', '.js', '.xml'][doc_id % 6 + 1] AS extension,
  'doc-' || doc_id || '-' || lang || ['.txt', '.adoc', '.java', '.sql', '.js', '.xml'][doc_id % 6 + 1] AS filename,
  '/corpus/' || lang || '/' || source || '/doc-' || doc_id || '-' || lang || ['.txt', '.adoc', '.java', '.sql', '.js', '.xml'][doc_id % 6 + 1] AS path,
  strlen(text) AS size_bytes, CAST(1700000000000 + doc_id * 1000 AS DOUBLE) AS modified_at_ms, text FROM documents)"""
_BLOCKS = f"""b AS (SELECT * FROM (SELECT doc_id + 1 AS document_id, unnest(string_split_regex(text, '\\r\\n|\\n|\\r')) AS content,
  generate_subscripts(string_split_regex(text, '\\r\\n|\\n|\\r'), 1) - 1 AS ordinal FROM documents) WHERE trim(content, {_SPACE}) <> '')"""


def query(sql: str | None = None) -> Callable:
    """Registers a query under its function's name."""

    def register(function: Callable) -> Callable:
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register


def _hits(found: DataFrame) -> DataFrame:
    return found.select("id", "path", F.col("rank").cast("long").alias("rank"), "source_kind", F.col("ordinal").cast("long").alias("ordinal"))


def _phrase_sql(term: str, where: str = "", order: str = "", extra: str = "") -> str:
    return f"""WITH {_DOCS}, {_BLOCKS}, s AS (SELECT * FROM d {where}),
h AS (SELECT document_id, min(ordinal) AS ordinal FROM b WHERE contains(lower(content), '{term}') GROUP BY document_id)
SELECT s.id, s.path, CAST(CASE WHEN lower(filename) = '{term}' THEN 4 WHEN contains(lower(filename), '{term}') THEN 3 ELSE 1 END AS BIGINT) AS rank,
  CASE WHEN contains(lower(filename), '{term}') THEN 'filename' ELSE 'content' END AS source_kind,
  CASE WHEN contains(lower(filename), '{term}') THEN NULL ELSE CAST(h.ordinal AS BIGINT) END AS ordinal {extra}
FROM s LEFT JOIN h ON h.document_id = s.id WHERE contains(lower(filename), '{term}') OR h.ordinal IS NOT NULL {order}"""


_ORDER = "ORDER BY rank DESC, modified_at_ms DESC, path"


def _corpus(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Documents and blocks of the stored index."""
    return corpus.indexed(spark, sf)[:2]


# Text and blocks ------------------------------------------------------------------------------------------------------


@query(f"WITH {_BLOCKS} SELECT document_id, CAST(ordinal AS BIGINT) AS ordinal, content, '第 ' || (ordinal + 1) || ' 行' AS location_value FROM b")
def parse_line_blocks(spark: SparkSession, sf: str) -> DataFrame:
    docs = corpus.table(spark, sf, "documents").select((F.col("doc_id") + 1).alias("document_id"), "text")
    return corpus.line_blocks(docs).select("document_id", F.col("ordinal").cast("long").alias("ordinal"), "content", "location_value")


@query("SELECT doc_id, lower(text) AS normalized FROM documents")
def normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.table(spark, sf, "documents").select("doc_id", norm(F.col("text")).alias("normalized"))


@query(f"WITH {_DOCS} SELECT id, id || '-' || sha256(path)[1:16] AS reference FROM d")
def document_references(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.corpus_documents(spark, sf).select("id", document_reference(F.col("id"), F.col("path")).alias("reference"))


@query(f"WITH {_DOCS} SELECT id, strftime(make_timestamp(CAST(modified_at_ms AS BIGINT) * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS modified_at FROM d")
def iso_times(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.corpus_documents(spark, sf).select("id", iso_time(F.col("modified_at_ms")).alias("modified_at"))


# Search ---------------------------------------------------------------------------------------------------------------


@query(_phrase_sql("the"))
def search_phrase(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(search.search(*_corpus(spark, sf), "the", limit=None))


@query(_phrase_sql("the", order=f"{_ORDER} LIMIT 20"))
def search_phrase_top20(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(search.search(*_corpus(spark, sf), "the", limit=20))


@query(_phrase_sql("doc-7-en.adoc"))
def search_filename_exact(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(search.search(*_corpus(spark, sf), "Doc-7-EN.adoc", limit=None))


@query(_phrase_sql("-de.sql"))
def search_filename_contains(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(search.search(*_corpus(spark, sf), " -de.SQL ", limit=None))


@query(_phrase_sql("and", where="WHERE extension IN ('.txt', '.js')"))
def search_type_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(search.search(*_corpus(spark, sf), "and", scope=search.Scope(types=(".txt", ".js")), limit=None))


@query(_phrase_sql("er", where="WHERE root_path = '/corpus' AND (path = '/corpus/de' OR starts_with(path, '/corpus/de/'))"))
def search_root_subtree(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(search.search(*_corpus(spark, sf), "er", scope=search.Scope(root="/corpus", subtree="/corpus/de"), limit=None))


_TERMS = ("der", "und", "in")
_ALL_SQL = f"""WITH {_DOCS}, {_BLOCKS}, f AS (SELECT document_id, ordinal, {", ".join(f"CAST(contains(lower(content), '{t}') AS INT) AS t{k}" for k, t in enumerate(_TERMS))} FROM b),
g AS (SELECT document_id, {", ".join(f"max(t{k}) AS s{k}" for k in range(3))}, coalesce(min(ordinal) FILTER (t0 + t1 + t2 = 3), arg_max(ordinal, (t0 + t1 + t2) * 10000000 - ordinal)) AS ordinal
      FROM f WHERE t0 + t1 + t2 > 0 GROUP BY document_id),
n AS (SELECT *, {" AND ".join(f"contains(lower(filename), '{t}')" for t in _TERMS)} AS named FROM d)
SELECT n.id, n.path, CAST(CASE WHEN named THEN 3 ELSE 1 END AS BIGINT) AS rank, CASE WHEN named THEN 'filename' ELSE 'content' END AS source_kind,
  CASE WHEN named THEN NULL ELSE CAST(g.ordinal AS BIGINT) END AS ordinal
FROM n LEFT JOIN g ON g.document_id = n.id WHERE named OR ({" AND ".join(f"(s{k} = 1 OR contains(lower(filename), '{t}'))" for k, t in enumerate(_TERMS))} AND g.document_id IS NOT NULL)"""


@query(_ALL_SQL)
def search_all_terms(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(search.search(*_corpus(spark, sf), "der  und\tin der", all_terms=True, limit=None))


@query("""WITH h AS (SELECT conv_id + 1 AS id, min(turn) FILTER (contains(lower(role), 'assist')) AS ho, min(turn) FILTER (contains(lower(text), 'assist')) AS bo FROM conversations GROUP BY conv_id)
SELECT CAST(id AS BIGINT) AS id, '/conversations/conv-' || (id - 1) || '.md' AS path, CAST(CASE WHEN ho IS NOT NULL THEN 2 ELSE 1 END AS BIGINT) AS rank,
  CASE WHEN ho IS NOT NULL THEN 'heading' ELSE 'content' END AS source_kind, CAST(coalesce(ho, bo) AS BIGINT) AS ordinal FROM h WHERE ho IS NOT NULL OR bo IS NOT NULL""")
def search_heading_tier(spark: SparkSession, sf: str) -> DataFrame:
    docs, blocks = corpus.conversation_documents(spark, sf), corpus.conversation_blocks(spark, sf)
    return _hits(search.search(docs, blocks, "assist", limit=None))


@query(f"SELECT *, CAST(ceil(position / 20.0) AS BIGINT) AS page FROM ({_phrase_sql('the', extra=f', row_number() OVER ({_ORDER}) AS position')})".replace("ORDER BY rank DESC", "ORDER BY (CASE WHEN lower(filename) = 'the' THEN 4 WHEN contains(lower(filename), 'the') THEN 3 ELSE 1 END) DESC"))
def search_paged(spark: SparkSession, sf: str) -> DataFrame:
    ranked = search.numbered(search.search(*_corpus(spark, sf), "the", limit=None))
    return ranked.select("id", "path", F.col("rank").cast("long").alias("rank"), "source_kind", F.col("ordinal").cast("long").alias("ordinal"), "position", F.ceil(F.col("position") / 20).alias("page"))


@query(f"""WITH {_DOCS}, {_BLOCKS}, one AS (SELECT id, row_number() OVER (ORDER BY contains(lower(filename), 'the')::INT DESC, modified_at_ms DESC, path) AS position, path FROM d
  WHERE contains(lower(filename), 'the') OR id IN (SELECT document_id FROM b WHERE contains(lower(content), 'the'))),
two AS (SELECT document_id, min(ordinal) AS ordinal FROM b WHERE contains(lower(content), 'and') GROUP BY document_id)
SELECT one.id, one.path, one.position, CAST(1 AS BIGINT) AS rank, CAST(two.ordinal AS BIGINT) AS ordinal FROM one JOIN two ON two.document_id = one.id""")
def search_refine_two_layers(spark: SparkSession, sf: str) -> DataFrame:
    docs, blocks = _corpus(spark, sf)
    first = stored(search.numbered(search.search(docs, blocks, "the", limit=None)).select("id", "position"), "layer")
    return search.refine(first, docs, blocks, "and").select("id", "path", "position", F.col("rank").cast("long").alias("rank"), F.col("ordinal").cast("long").alias("ordinal"))


@query(f"SELECT * FROM ({_phrase_sql('e', extra=', count(*) OVER () AS total_hits, count(*) OVER () > 500 AS truncated', order=_ORDER + ' LIMIT 500')})")
def search_window_500(spark: SparkSession, sf: str) -> DataFrame:
    found = search.windowed(search.search(*_corpus(spark, sf), "e", limit=None))
    return found.select("id", "path", F.col("rank").cast("long").alias("rank"), "source_kind", F.col("ordinal").cast("long").alias("ordinal"), "total_hits", "truncated")


@query(f"WITH {_BLOCKS} SELECT document_id, CAST(ordinal AS BIGINT) AS ordinal, content FROM b WHERE contains(lower(content), 'of the') QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY ordinal) = 1")
def representative_block(spark: SparkSession, sf: str) -> DataFrame:
    return search.representatives(_corpus(spark, sf)[1], "of the").withColumn("ordinal", F.col("ordinal").cast("long"))


@query(f"""WITH {_BLOCKS}, r AS (SELECT document_id, ordinal, row_number() OVER (PARTITION BY document_id ORDER BY ordinal) AS passage_no FROM b WHERE contains(lower(content), 'the'))
SELECT document_id, CAST(ordinal AS BIGINT) AS ordinal, CAST(1 AS BIGINT) AS rank, passage_no FROM r WHERE passage_no <= 3""")
def matching_passages(spark: SparkSession, sf: str) -> DataFrame:
    found = passages.phrase_passages(_corpus(spark, sf)[1], "the")
    return found.select("document_id", F.col("ordinal").cast("long").alias("ordinal"), F.col("rank").cast("long").alias("rank"), F.col("passage_no").cast("long").alias("passage_no"))


_WORDS3 = ("the", "and", "of")
_NEW = "+".join(f"greatest(f.t{k} - c.t{k}, 0)" for k in range(3))
_NEXT = "struct_pack(ordinal := f.ordinal, t0 := f.t0, t1 := f.t1, t2 := f.t2)"


@query(f"""WITH {_DOCS}, {_BLOCKS}, f AS (SELECT document_id, ordinal, {", ".join(f"CAST(contains(lower(content), '{t}') AS INT) AS t{k}" for k, t in enumerate(_WORDS3))} FROM b),
v AS (SELECT document_id FROM f JOIN d ON d.id = f.document_id GROUP BY document_id HAVING {" AND ".join(f"max(t{k} + CAST(contains(lower(filename), '{t}') AS INT)) > 0" for k, t in enumerate(_WORDS3))}),
g AS (SELECT * FROM f JOIN v USING (document_id) WHERE t0 + t1 + t2 > 0),
p1 AS (SELECT document_id, arg_max({_NEXT}, (t0 + t1 + t2) * 10000000 - ordinal) AS p FROM g f GROUP BY document_id),
c1 AS (SELECT document_id, p.ordinal AS o1, -1 AS o2, p.t0 AS t0, p.t1 AS t1, p.t2 AS t2 FROM p1),
p2 AS (SELECT f.document_id, arg_max({_NEXT}, (({_NEW}) * 4 + f.t0 + f.t1 + f.t2) * 10000000 - f.ordinal) AS p FROM g f JOIN c1 c ON c.document_id = f.document_id AND f.ordinal <> c.o1 GROUP BY f.document_id),
c2 AS (SELECT c.document_id, o1, p.ordinal AS o2, greatest(c.t0, p.t0) AS t0, greatest(c.t1, p.t1) AS t1, greatest(c.t2, p.t2) AS t2 FROM c1 c JOIN p2 USING (document_id)),
p3 AS (SELECT f.document_id, arg_max({_NEXT}, (({_NEW}) * 4 + f.t0 + f.t1 + f.t2) * 10000000 - f.ordinal) AS p FROM g f JOIN c2 c ON c.document_id = f.document_id AND f.ordinal <> c.o1 AND f.ordinal <> c.o2 GROUP BY f.document_id)
SELECT document_id, CAST(n AS BIGINT) AS passage_no, CAST(p.ordinal AS BIGINT) AS ordinal, CAST(1 AS BIGINT) AS rank, CAST(p.t0 + p.t1 + p.t2 AS BIGINT) AS matched, CAST(3 AS BIGINT) AS terms
FROM (SELECT *, 1 AS n FROM p1 UNION ALL SELECT *, 2 FROM p2 UNION ALL SELECT *, 3 FROM p3)""")
def matching_passages_all_terms(spark: SparkSession, sf: str) -> DataFrame:
    found = passages.all_terms_passages(*_corpus(spark, sf), " ".join(_WORDS3))
    return found.select(*(F.col(c).cast("long").alias(c) for c in ("document_id", "passage_no", "ordinal", "rank", "matched", "terms")))


@query(f"""WITH x AS (SELECT h.id, h.rank, coalesce(l.content, h.filename) AS source FROM ({_phrase_sql("the", order=f"{_ORDER} LIMIT 20", extra=", s.filename")}) h
  LEFT JOIN (WITH {_BLOCKS} SELECT * FROM b) l ON l.document_id = h.id AND l.ordinal = h.ordinal),
y AS (SELECT id, rank, source, strpos(lower(source), 'the') AS spot FROM x),
z AS (SELECT id, rank, regexp_replace(left(source, greatest(spot - 1, 0)), '\\s+', ' ', 'g') AS before, CASE WHEN spot > 0 THEN substring(source, spot, 3) ELSE '' END AS hit,
  regexp_replace(substring(source, CASE WHEN spot > 0 THEN spot + 3 ELSE 1 END), '\\s+', ' ', 'g') AS after FROM y),
w AS (SELECT *, least(45, length(before)) AS l, 158 - least(45, length(before)) - length(hit) AS r FROM z)
SELECT id, rank, trim(CASE WHEN l < length(before) THEN '…' ELSE '' END || right(before, l) || hit || left(after, r) || CASE WHEN r < length(after) THEN '…' ELSE '' END, {_SPACE}) AS text, FALSE AS truncated FROM w""")
def snippet_page(spark: SparkSession, sf: str) -> DataFrame:
    """Snippets of the first page: the hits are chosen first, and only their blocks are read for text."""
    docs, blocks = _corpus(spark, sf)
    first = search.search(docs, blocks, "the", limit=20).select("id", "rank", "filename", "ordinal")
    text = blocks.select(F.col("document_id").alias("id"), "ordinal", "content")
    rows = first.join(text, ["id", "ordinal"], "left").select("id", "rank", F.coalesce("content", "filename").alias("source"))
    return rows.withColumn("snippet", snippets(F.col("source"), ["the"])).select("id", "rank", "snippet.text", "snippet.truncated")


@query(f"WITH {_DOCS} SELECT id, path, status FROM (SELECT *, 'indexed' AS status FROM d) WHERE path = '/corpus/en/src7/doc-7-en.adoc' OR id = 10")
def document_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return search.by_place(_corpus(spark, sf)[0], paths=("/corpus/en/src7/doc-7-en.adoc",), ids=(10,)).select("id", "path", "status")


@query(f"""WITH h AS ({_phrase_sql('the', extra=", modified_at_ms")}), n AS (SELECT *, row_number() OVER ({_ORDER}) AS position, count(*) OVER () AS total_hits FROM h)
SELECT position, id || '-' || sha256(path)[1:16] AS reference, path, CASE rank WHEN 4 THEN '檔名完全符合' WHEN 3 THEN '檔名包含' ELSE '內容' END AS reason, strftime(make_timestamp(CAST(modified_at_ms AS BIGINT) * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS modified_at,
  total_hits, total_hits > 500 AS truncated FROM n WHERE position BETWEEN 21 AND 40""")
def search_documents_page(spark: SparkSession, sf: str) -> DataFrame:
    return search.search_page(*_corpus(spark, sf), "the", 2, 20)


@query(f"""WITH h AS ({_ALL_SQL}) SELECT id, CASE rank WHEN 3 THEN '檔名包含（全部關鍵字）' ELSE '內容（全部關鍵字）' END AS reason FROM h""")
def search_reasons(spark: SparkSession, sf: str) -> DataFrame:
    hits = search.search(*_corpus(spark, sf), "der und in", all_terms=True, limit=None)
    return hits.select("id", search.reason(F.col("rank"), True).alias("reason"))


# Candidate pruning ----------------------------------------------------------------------------------------------------

_GRAMS = f"""{_BLOCKS}, p AS (SELECT DISTINCT document_id, unnest(list_transform(range(1, CAST(len(lower(content)) AS BIGINT) - 1), lambda i: substring(lower(content), i, 3))) AS gram FROM b)"""


@query(f"WITH {_GRAMS} SELECT gram, count(*) AS documents FROM p GROUP BY gram")
def trigram_postings(spark: SparkSession, sf: str) -> DataFrame:
    counts = corpus.indexed(spark, sf).postings.groupBy("gram").agg(F.count("*").alias("documents"))
    return counts.select(candidates.gram_text(F.col("gram")).alias("gram"), "documents")


@query(f"WITH {_GRAMS} SELECT document_id FROM p WHERE gram IN ('ter', 'ers', 'rst', 'sta', 'tan', 'and') GROUP BY document_id HAVING count(*) = 6")
def trigram_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return candidates.candidates(corpus.indexed(spark, sf).postings, "terstand")


@query(_phrase_sql("license"))
def search_pruned(spark: SparkSession, sf: str) -> DataFrame:
    docs, blocks, posted = corpus.indexed(spark, sf)
    return _hits(search.search(docs, blocks, "license", limit=None, candidates=candidates.candidates(posted, "license")))


@query(f"WITH {_DOCS}, {_GRAMS} SELECT (SELECT count(*) FROM d) AS documents, (SELECT count(*) FROM b) AS blocks, (SELECT count(*) FROM p) AS postings")
def index_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Builds the index of the corpus anew, for the session's searches too, and counts what it holds."""
    made = corpus.indexed(spark, sf, anew=True)
    counts = [df.agg(F.count("*").alias(name)) for name, df in made._asdict().items()]
    return counts[0].join(counts[1], how="cross").join(counts[2], how="cross")  # one row each


@query(f"WITH {_DOCS}, {_GRAMS} SELECT id FROM d WHERE id NOT IN (SELECT document_id FROM p)")
def documents_without_postings(spark: SparkSession, sf: str) -> DataFrame:
    found = corpus.indexed(spark, sf)
    return candidates.without_postings(found.documents, found.postings).select("id")


@query(f"WITH {_GRAMS} SELECT document_id FROM p WHERE gram IN ('ter', 'erm') GROUP BY document_id HAVING count(*) = 2 UNION SELECT document_id FROM p WHERE gram IN ('lic', 'ice') GROUP BY document_id HAVING count(*) = 2")
def trigram_any_term(spark: SparkSession, sf: str) -> DataFrame:
    return candidates.may_contain_any(corpus.indexed(spark, sf).postings, ["term", "lice"])


# Incremental indexing -------------------------------------------------------------------------------------------------

_PREVIOUS = """p AS (SELECT path, CASE id % 11 WHEN 0 THEN 'error' WHEN 1 THEN 'unsupported' WHEN 2 THEN 'too_large' ELSE 'indexed' END AS status, CASE WHEN id % 5 = 0 THEN NULL ELSE 1 END AS parse_version,
  size_bytes + CASE WHEN id % 13 = 0 THEN 1 ELSE 0 END AS size_bytes, modified_at_ms + CASE WHEN id % 17 = 0 THEN 0.5 ELSE 0 END AS modified_at_ms FROM d WHERE id % 7 <> 0)"""
_COMPARED = f"""{_DOCS}, {_PREVIOUS}, c AS (SELECT d.id, d.path, d.extension, d.size_bytes, CASE WHEN p.status IS NULL THEN 'added' WHEN d.size_bytes <> p.size_bytes OR d.modified_at_ms <> p.modified_at_ms THEN 'source-changed'
  WHEN p.status = 'error' THEN 'error-retry' WHEN p.status <> 'too_large' AND coalesce(p.parse_version, 0) < 1 THEN 'text-upgrade' WHEN p.status = 'unsupported' THEN 'unsupported-retry' ELSE 'unchanged' END AS reason
  FROM d LEFT JOIN p USING (path))"""


def _listing(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs = corpus.corpus_documents(spark, sf)
    k = F.col("id") % 11
    old = docs.where("id % 7 <> 0").select(
        "path",
        F.when(k == 0, "error").when(k == 1, "unsupported").when(k == 2, "too_large").otherwise("indexed").alias("status"),
        F.when(F.col("id") % 5 != 0, 1).alias("parse_version"),
        (F.col("size_bytes") + F.when(F.col("id") % 13 == 0, 1).otherwise(0)).alias("size_bytes"),
        (F.col("modified_at_ms") + F.when(F.col("id") % 17 == 0, 0.5).otherwise(0.0)).alias("modified_at_ms"),
    )
    return docs.select("id", "path", "filename", "extension", "size_bytes", "modified_at_ms"), old


@query(f"WITH {_COMPARED} SELECT id, path, reason, CASE WHEN reason = 'unchanged' THEN 'skip' ELSE 'parse' END AS action FROM c")
def classify_reprocess(spark: SparkSession, sf: str) -> DataFrame:
    return classify.compare(*_listing(spark, sf)).select("id", "path", "reason", "action")


@query(f"WITH {_COMPARED} SELECT reason, count(*) AS files FROM c GROUP BY reason")
def reason_counts(spark: SparkSession, sf: str) -> DataFrame:
    return classify.reason_counts(classify.compare(*_listing(spark, sf)))


@query(f"""WITH {_COMPARED} SELECT count(*) AS found, count(*) FILTER (reason = 'added') AS added, count(*) FILTER (reason NOT IN ('added', 'unchanged')) AS reprocessed,
  count(*) FILTER (reason = 'unchanged') AS unchanged, count(*) FILTER (reason <> 'unchanged') AS parser_calls, CAST(0 AS BIGINT) AS metadata_only FROM c""")
def sync_totals(spark: SparkSession, sf: str) -> DataFrame:
    return classify.sync_totals(classify.compare(*_listing(spark, sf)))


@query(f"WITH {_DOCS} SELECT extension, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM d GROUP BY extension")
def format_totals(spark: SparkSession, sf: str) -> DataFrame:
    return classify.format_totals(corpus.corpus_documents(spark, sf))


@query(f"WITH {_DOCS} SELECT id, CASE WHEN id % 10 = 3 AND starts_with(path, '/corpus/en/') THEN 'deleted' ELSE 'kept' END AS outcome FROM d")
def remove_missing(spark: SparkSession, sf: str) -> DataFrame:
    docs = corpus.corpus_documents(spark, sf)
    return maintain.remove_missing(docs, docs.where("id % 10 <> 3"), root="/corpus", subtree="/corpus/en").select("id", "outcome")


@query(f"WITH {_DOCS} SELECT id, CASE WHEN id % 10 <> 3 THEN 'kept' WHEN starts_with(path, '/corpus/fr/') OR starts_with(path, '/corpus/en/src3/') THEN 'protected' ELSE 'deleted' END AS outcome FROM d")
def remove_missing_protected(spark: SparkSession, sf: str) -> DataFrame:
    docs = corpus.corpus_documents(spark, sf)
    scopes = spark.createDataFrame([("/corpus/fr",), ("/corpus/en/src3/",)], "path string")
    return maintain.remove_missing(docs, docs.where("id % 10 <> 3"), root="/corpus", protected=scopes).select("id", "outcome")


@query(f"""WITH {_DOCS}, o AS (SELECT id, path, size_bytes FROM d WHERE id % 4 <> 0), c AS (SELECT path, size_bytes + 1 AS size_bytes FROM d WHERE id % 4 = 0 OR id % 6 = 1),
  n AS (SELECT path, row_number() OVER (ORDER BY path) + (SELECT max(id) FROM o) AS id FROM c WHERE path NOT IN (SELECT path FROM o))
SELECT coalesce(o.id, n.id) AS id, path, coalesce(c.size_bytes, o.size_bytes) AS size_bytes FROM o FULL JOIN c USING (path) LEFT JOIN n USING (path)""")
def merge_upsert_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """The merged snapshot is written and read back; new paths have gapless ids in the order of their paths."""
    docs = corpus.corpus_documents(spark, sf).select("id", "path", "size_bytes")
    changed = docs.where("id % 4 = 0 or id % 6 = 1").select("path", (F.col("size_bytes") + 1).alias("size_bytes"))
    return stored(maintain.upsert(docs.where("id % 4 <> 0"), changed), "snapshot")


@query(f"WITH {_DOCS} SELECT id, CASE WHEN id % 3 = 2 THEN '/old/c' WHEN id % 3 = 1 THEN '/corpus' ELSE '/corpus' END AS root_path FROM d")
def merge_child_roots(spark: SparkSession, sf: str) -> DataFrame:
    docs = corpus.corpus_documents(spark, sf)
    k = F.col("id") % 3
    owned = docs.withColumn("root_path", F.when(k == 0, "/corpus/en").when(k == 1, "/corpus/de").otherwise("/old/c"))
    return maintain.merge_roots(owned, "/corpus", ["/corpus/en", "/corpus/de"]).select("id", "root_path")


@query(f"WITH {_DOCS} SELECT id, CASE WHEN id % 9 = 0 THEN size_bytes + 5 ELSE size_bytes END AS size_bytes, CASE WHEN id % 9 = 0 THEN 'unsupported' ELSE 'indexed' END AS status FROM d")
def touch_metadata(spark: SparkSession, sf: str) -> DataFrame:
    docs = corpus.corpus_documents(spark, sf)
    seen = docs.where("id % 9 = 0").select("path", (F.col("size_bytes") + 5).alias("size_bytes"), "modified_at_ms", F.lit("unsupported").alias("status"))
    return maintain.touch(docs, seen).select("id", "size_bytes", "status")


@query(f"WITH {_BLOCKS} SELECT document_id, count(*) AS blocks FROM b WHERE document_id % 8 <> 1 GROUP BY document_id")
def remove_cascade(spark: SparkSession, sf: str) -> DataFrame:
    docs, blocks = _corpus(spark, sf)
    left = maintain.remove_documents(docs, blocks, docs.where("id % 8 = 1").select("id"))[1]
    return left.groupBy("document_id").agg(F.count("*").alias("blocks"))


# Statistics -----------------------------------------------------------------------------------------------------------

_STATUS_SQL = "CASE doc_id % 9 WHEN 0 THEN 'no_text' WHEN 1 THEN 'error' WHEN 2 THEN 'unsupported' ELSE 'indexed' END"
_STATUS_DOCS = f"s AS (SELECT *, CASE (id - 1) % 9 WHEN 0 THEN 'no_text' WHEN 1 THEN 'error' WHEN 2 THEN 'unsupported' ELSE 'indexed' END AS status, CASE WHEN id % 4 = 0 THEN NULL ELSE 1 END AS parse_version FROM d)"


def _with_status(spark: SparkSession, sf: str) -> DataFrame:
    k = (F.col("id") - 1) % 9
    docs = corpus.corpus_documents(spark, sf)
    status = F.when(k == 0, "no_text").when(k == 1, "error").when(k == 2, "unsupported").otherwise("indexed")
    return docs.withColumns({"status": status, "parse_version": F.when(F.col("id") % 4 != 0, 1), "error_code": F.when(k == 1, "PARSE_ERROR"), "error_message": F.when(k == 1, F.concat(F.lit("at "), F.col("filename")))})


@query(f"""WITH {_DOCS}, {_STATUS_DOCS}, e AS (SELECT unnest(['indexed', 'no_text', 'unsupported', 'too_large', 'encrypted', 'error']) AS status)
SELECT e.status, count(s.id) AS documents FROM e LEFT JOIN s USING (status) GROUP BY e.status""")
def status_counts_zero_filled(spark: SparkSession, sf: str) -> DataFrame:
    return stats.status_counts(_with_status(spark, sf))


@query(f"""WITH {_DOCS}, {_STATUS_DOCS} SELECT extension, count(*) AS documents, CAST(sum(size_bytes) AS BIGINT) AS source_bytes,
{", ".join(f"count(*) FILTER (status = '{x}') AS {x}" for x in ("indexed", "no_text", "unsupported", "too_large", "encrypted", "error"))} FROM s GROUP BY extension""")
def extension_stats(spark: SparkSession, sf: str) -> DataFrame:
    return stats.extension_stats(_with_status(spark, sf))


@query(f"WITH {_DOCS}, {_STATUS_DOCS} SELECT extension, count(*) AS documents FROM s WHERE parse_version IS NULL GROUP BY extension")
def text_upgrade_pending(spark: SparkSession, sf: str) -> DataFrame:
    return stats.text_upgrade_pending(_with_status(spark, sf))


@query(f"WITH {_DOCS}, {_BLOCKS} SELECT (SELECT count(*) FROM d) AS documents, (SELECT count(*) FROM b) AS blocks, (SELECT CAST(sum(length(content)) AS BIGINT) FROM b) AS characters")
def content_stats(spark: SparkSession, sf: str) -> DataFrame:
    return stats.content_stats(*_corpus(spark, sf))


@query(f"WITH {_DOCS} SELECT root_path, count(*) AS documents FROM d GROUP BY root_path")
def document_count_by_root(spark: SparkSession, sf: str) -> DataFrame:
    return stats.documents_by_root(corpus.corpus_documents(spark, sf))


@query(f"WITH {_DOCS}, {_STATUS_DOCS} SELECT path, status, 'PARSE_ERROR' AS error_code, 'at ' || filename AS error_message FROM s WHERE status = 'error' ORDER BY path")
def document_issues(spark: SparkSession, sf: str) -> DataFrame:
    return stats.issues(_with_status(spark, sf))


@query("SELECT event_type AS stage, CAST(user_id % 4 AS VARCHAR) AS code, count(*) AS n FROM events GROUP BY ALL UNION ALL SELECT event_type, NULL, count(*) FROM events GROUP BY ALL")
def diagnostic_counts(spark: SparkSession, sf: str) -> DataFrame:
    events = corpus.table(spark, sf, "events")
    return stats.diagnostic_counts(events.select(F.col("event_type").alias("stage"), (F.col("user_id") % 4).cast("string").alias("code")))


@query("SELECT lang, count(n_chars) AS n, quantile_disc(n_chars, 0.5) AS p50, quantile_disc(n_chars, 0.95) AS p95, max(n_chars) AS max FROM documents GROUP BY lang")
def profile_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return stats.percentiles(corpus.table(spark, sf, "documents"), "lang", "n_chars")


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20")
def slowest_files(spark: SparkSession, sf: str) -> DataFrame:
    return stats.slowest(corpus.table(spark, sf, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id")


@query(f"WITH {_DOCS} SELECT extension, count(*) AS files, CASE WHEN count(*) FILTER (id % 50 = 0) = 0 THEN CAST(sum(size_bytes) AS BIGINT) END AS bytes FROM d GROUP BY extension")
def storage_totals(spark: SparkSession, sf: str) -> DataFrame:
    files = corpus.corpus_documents(spark, sf).withColumn("size_bytes", F.when(F.col("id") % 50 != 0, F.col("size_bytes")))
    return stats.storage_total(files, "extension")


# Paths and roots ------------------------------------------------------------------------------------------------------


@query(f"""WITH {_DOCS} SELECT id, NOT (regexp_matches(path, '(?i)(^|/)doc-1[^/]*\\.sql$') OR starts_with(path, '/corpus/en/src3/') OR regexp_matches(path, '(?i)^/corpus/[^/]*/src1[^/]/')) AS listed FROM d""")
def ignore_rules_applied(spark: SparkSession, sf: str) -> DataFrame:
    rules = paths.ignore_rules("# rules\nDOC-1*.sql\n/corpus/en/src3/\ncorpus/*/src1?/\n")
    docs = corpus.corpus_documents(spark, sf)
    return docs.select("id", (~paths.ignored(F.expr("substring(path, 2)"), F.lit(False), rules)).alias("listed"))


@query(f"""WITH {_DOCS} SELECT id, CASE WHEN starts_with(path, '/corpus/en/src1/') THEN '/corpus/en/src1' WHEN starts_with(path, '/corpus/en/') THEN '/corpus/en' ELSE '/corpus' END AS root FROM d""")
def path_cover_join(spark: SparkSession, sf: str) -> DataFrame:
    """The most specific covering root of each document: an equality join on its ancestors."""
    roots = spark.createDataFrame([("/corpus",), ("/corpus/en",), ("/corpus/en/src1",), ("/corpus/e",)], "root string")
    return maintain.covering_roots(corpus.corpus_documents(spark, sf), roots)


def _history(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.table(spark, sf, "nation").select(F.concat(F.lit("/r/"), F.col("n_nationkey").cast("string")).alias("former_path"), F.concat(F.lit("/r/"), F.floor(F.col("n_nationkey") / 2 + 12).cast("string")).alias("parent_path")).where("former_path <> parent_path")


@query("""WITH RECURSIVE e AS (SELECT '/r/' || n_nationkey AS f, '/r/' || CAST(floor(n_nationkey / 2.0 + 12) AS BIGINT) AS p FROM nation WHERE n_nationkey <> CAST(floor(n_nationkey / 2.0 + 12) AS BIGINT)),
w AS (SELECT f, p, 1 AS steps FROM e UNION ALL SELECT w.f, e.p, w.steps + 1 FROM w JOIN e ON e.f = w.p)
SELECT f AS former_path, p AS current_path, CAST(steps AS BIGINT) AS steps FROM w WHERE p NOT IN (SELECT f FROM e)""")
def root_history_closure(spark: SparkSession, sf: str) -> DataFrame:
    return maintain.root_history(_history(spark, sf))


@query("SELECT DISTINCT '/r' AS root_path, 's' || (s_suppkey % 5) AS base_path FROM supplier UNION SELECT '/r', unnest(['/r/a', '/r/b'])")
def merged_ignore_scopes(spark: SparkSession, sf: str) -> DataFrame:
    scopes = corpus.table(spark, sf, "supplier").select(F.when(F.col("s_suppkey") % 2 == 0, "/r/a").otherwise("/r/b").alias("root_path"), F.concat(F.lit("s"), (F.col("s_suppkey") % 5).cast("string")).alias("base_path"))
    return maintain.merged_ignore_scopes(scopes, "/r", ["/r/a", "/r/b"])


# Live updates ---------------------------------------------------------------------------------------------------------


@query(f"""WITH {_DOCS}, p AS (SELECT DISTINCT CASE WHEN id % 40 = 0 THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE path END AS path FROM d)
SELECT path FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE starts_with(p.path, q.path || '/'))""")
def absorb_pending_paths(spark: SparkSession, sf: str) -> DataFrame:
    docs = corpus.corpus_documents(spark, sf)
    return live.absorb(docs.select(F.when(F.col("id") % 40 == 0, F.regexp_extract("path", "^(.*)/[^/]*$", 1)).otherwise(F.col("path")).alias("path")))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT CAST(user_id AS VARCHAR) AS root, count(*) AS events, min(ts) AS first_at, max(ts) AS last_at FROM s GROUP BY user_id, n""")
def debounce_sessions(spark: SparkSession, sf: str) -> DataFrame:
    events = corpus.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("root"), "ts")
    return live.debounced(events, "30 minutes").select("root", "events", "first_at", "last_at")


@query("SELECT CAST(user_id AS VARCHAR) AS root, count(DISTINCT event_id) AS pending, CASE WHEN count(DISTINCT event_id) > 60 THEN 'reconcile' ELSE 'local' END AS mode FROM events GROUP BY user_id")
def queue_overflow(spark: SparkSession, sf: str) -> DataFrame:
    events = corpus.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("root"), F.col("event_id").cast("string").alias("path"))
    return live.queue_modes(events, limit=60)


@query("""WITH t AS (SELECT conv_id, turn, text, CASE WHEN role = 'user' THEN text END AS h FROM conversations)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, last_value(h IGNORE NULLS) OVER w AS heading, CAST(count(h) OVER w AS BIGINT) AS section FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)""")
def running_heading(spark: SparkSession, sf: str) -> DataFrame:
    turns = corpus.table(spark, sf, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(F.col("role") == "user", F.col("text")).alias("own"))
    return passages.running_headings(turns, "conv_id", "turn", "own").drop("own")


@query(f"""WITH {_DOCS}, e AS (SELECT id, CASE id % 5 WHEN 0 THEN NULL WHEN 1 THEN '/corpus' WHEN 2 THEN '/corpus/node_modules/' || filename WHEN 3 THEN '/elsewhere/' || filename ELSE path END AS path FROM d)
SELECT id, CASE WHEN id % 5 < 2 THEN 'reconcile' ELSE 'local' END AS route FROM e WHERE id % 5 IN (0, 1, 4)""")
def watch_routes(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("id") % 5
    path = F.when(k == 1, "/corpus").when(k == 2, F.concat(F.lit("/corpus/node_modules/"), "filename")).when(k == 3, F.concat(F.lit("/elsewhere/"), "filename")).when(k == 4, F.col("path"))
    return live.routed(corpus.corpus_documents(spark, sf).select("id", F.lit("/corpus").alias("root"), path.alias("path"))).select("id", "route")


@query("SELECT event_type AS phase, CAST(sum(user_id) AS BIGINT) AS ms, max(event_id) AS memory_bytes FROM events GROUP BY event_type")
def phase_totals(spark: SparkSession, sf: str) -> DataFrame:
    return stats.phase_totals(corpus.table(spark, sf, "events").select(F.col("event_type").alias("phase"), F.col("user_id").alias("ms"), F.col("event_id").alias("memory_bytes")))


# Formats and context --------------------------------------------------------------------------------------------------


@query()
def parse_html_blocks(spark: SparkSession, sf: str) -> DataFrame:
    pages = corpus.table(spark, sf, "pages")
    return parse_column(pages.select(F.col("page_id").alias("document_id"), F.lit("page.html").alias("filename"), F.encode("html", "UTF-8").alias("content")))


_NAMED = "f AS (SELECT n_nationkey AS k, n_name AS t, 'the line of ' || n_name AS x FROM nation)"


def _file_sql(*rows: tuple[int, str, str, str, str]) -> str:
    """rows: ordinal, and SQL of heading, content, location kind and place; t is the title, x the line."""
    one = lambda r: f"SELECT CAST(k AS BIGINT) AS document_id, CAST({r[0]} AS BIGINT) AS ordinal, CAST({r[1]} AS VARCHAR) AS heading, {r[2]} AS content, '{r[3]}' AS location_kind, {r[4]} AS location_value FROM f"
    return f"WITH {_NAMED} " + " UNION ALL ".join(map(one, rows))


def _parsed_files(spark: SparkSession, sf: str, extension: str) -> DataFrame:
    rows = corpus.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("document_id"), "n_name")
    made = samples.files(rows, extension, F.col("n_name"), F.concat(F.lit("the line of "), "n_name"))
    return parse_column(made).select("document_id", F.col("ordinal").cast("long").alias("ordinal"), "heading", "content", "location_kind", "location_value")


_BR = "chr(10)"
#: By format: what its sample file has to give.
_FILE_SQL = {
    ".txt": _file_sql((0, "NULL", "t", "line", "'第 1 行'"), (2, "NULL", "x", "line", "'第 3 行'")),
    ".md": _file_sql((0, "NULL", "'before'", "section", "'第 1 行'"), (1, "t", f"'# ' || t || {_BR} || x", "section", "'第 2 行'"), (2, "'Next'", "'## Next'", "section", "'第 5 行'")),
    ".csv": _file_sql((0, "NULL", "t || ' | size'", "line", "'第 1 列（A–B）'"), (1, "NULL", "x || ', and \"more\" | ' || length(x)", "line", "'第 2 列（A–B）'")),
    ".xml": _file_sql((0, "NULL", "'<?xml version=\"1.0\"?>'", "line", "'第 1 行'"), (1, "NULL", "'<item name=\"' || t || '\">' || x || '</item>'", "line", "'第 2 行'")),
    ".html": _file_sql(*((k, "t", v, "section", f"'網頁擷取段落 {k + 1}'") for k, v in enumerate(("t", "x", "'next'", "'/' || t || ' link'")))),
    ".mht": _file_sql((0, "t", "t", "section", "'網頁擷取段落 1'"), (1, "t", "x", "section", "'網頁擷取段落 2'")),
    ".rtf": _file_sql((0, "NULL", "t", "section", "'段落 1'"), (1, "NULL", "x", "section", "'段落 2'")),
    ".docx": _file_sql((0, "t", "t", "section", "'第 1 段'"), (1, "t", "x", "section", "'第 2 段'"), (2, "t", "t", "section", "'表格 1，第 1 列第 1 欄'"), (3, "t", "x", "section", "'表格 1，第 1 列第 2 欄'")),
    ".pptx": _file_sql((0, "t", f"t || {_BR} || x", "slide", "'投影片 1'")),
    ".xlsx": _file_sql((0, "t", "x", "sheet_cell", "'工作表「' || t || '」!A1'"), (1, "t", "CAST(length(x) AS VARCHAR)", "sheet_cell", "'工作表「' || t || '」!B1'"), (2, "t", "'TRUE'", "sheet_cell", "'工作表「' || t || '」!C3'")),
    ".odt": _file_sql((0, "t", "t", "section", "'標題 1'"), (1, "t", "x", "section", "'段落 2'"), (2, "t", "t || ' | ' || x", "section", "'表格列 3'")),
    ".pdf": _file_sql((0, "NULL", "t", "page", "'第 1 頁'"), (1, "NULL", "x", "page", "'第 2 頁'")),
}

for _extension, _sql in _FILE_SQL.items():
    QUERIES[f"parse_files_{_extension[1:]}"] = partial(_parsed_files, extension=_extension)
    ORACLE_SQL[f"parse_files_{_extension[1:]}"] = _sql

#: File name, bytes, and the status and code that they have to give.
_ODD_FILES = [
    ("a.docx", b"no package", "error", "OFFICE_CORRUPT"),
    ("b.csv", b'a"b', "error", "CSV_FORMAT_ERROR"),
    ("c.pdf", b"nothing", "error", "PDF_CORRUPT"),
    ("d.mht", b"no header", "error", "MHT_FORMAT_ERROR"),
    ("e.xml", b'<?xml version="1.0" encoding="nonsense"?><a/>', "error", "XML_ENCODING_UNSUPPORTED"),
    ("f.xml", b'<?xml version="1.0" encoding="utf-8"?><a>\xff</a>', "error", "XML_DECODE_ERROR"),
    ("g.txt", b"\xff\xff\x80", "error", "TEXT_DECODE_ERROR"),
    ("h.html", b'<meta charset="nonsense">x', "error", "ENCODING_UNSUPPORTED"),
    ("i.msg", b"x", "error", "MSG_FORMAT_ERROR"),
    ("j.doc", b"x", "error", "DOC_FORMAT_ERROR"),
    ("k.xls", b"x", "error", "XLS_FORMAT_ERROR"),
    ("l.rtf", b"{\\rtf1 {", "error", "RTF_INVALID"),
    ("m.bin", b"x", "unsupported", None),
    ("n.txt", b" \n\t", "no_text", None),
    ("o.md", None, "error", "FILE_READ_FAILED"),
    ("p.pptx", bytes.fromhex("d0cf11e0a1b11ae1"), "error", "OFFICE_ENCRYPTED_OR_LEGACY"),
]


@query(" UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) AS document_id, '{status}' AS status, {f"'{code}'" if code else 'CAST(NULL AS VARCHAR)'} AS error_code" for k, (_, _, status, code) in enumerate(_ODD_FILES)))
def parse_odd_files(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(k, name, bytearray(content) if content is not None else None) for k, (name, content, *_) in enumerate(_ODD_FILES)]
    return parse_column(spark.createDataFrame(rows, "document_id long, filename string, content binary")).select("document_id", "status", "error_code")


@query(f"""WITH {_DOCS}, {_BLOCKS}, t AS (SELECT id, path, filename, modified_at_ms FROM d WHERE contains(lower(filename), 'the') OR id IN (SELECT document_id FROM b WHERE contains(lower(content), 'the'))
  ORDER BY contains(lower(filename), 'the')::INT DESC, modified_at_ms DESC, path LIMIT 5),
r AS (SELECT document_id, ordinal, content, row_number() OVER (PARTITION BY document_id ORDER BY ordinal) AS passage_no FROM b WHERE contains(lower(content), 'the'))
SELECT t.id || '-' || sha256(t.path)[1:16] AS reference, CAST(r.passage_no AS BIGINT) AS passage_no, CAST(r.ordinal AS BIGINT) AS ordinal, r.content FROM t JOIN r ON r.document_id = t.id AND r.passage_no <= 3""")
def context_passages(spark: SparkSession, sf: str) -> DataFrame:
    rows = context.bundle(*_corpus(spark, sf), "the", limit=5).select("reference", F.explode("passages").alias("p"))
    return rows.select("reference", F.col("p.passage_no").cast("long").alias("passage_no"), F.col("p.ordinal").cast("long").alias("ordinal"), "p.content")


@query(f"""WITH {_DOCS} SELECT id, CASE WHEN id % 6 = 0 THEN 'gone' ELSE 'changed' END AS outcome FROM d WHERE id % 6 = 0 OR id % 10 = 1""")
def changed_results(spark: SparkSession, sf: str) -> DataFrame:
    docs = corpus.corpus_documents(spark, sf).select("id", "path", "size_bytes", F.when(F.col("id") % 4 != 0, F.col("filename")).alias("filename"))
    now = docs.where("id % 6 <> 0").withColumn("size_bytes", F.col("size_bytes") + F.when(F.col("id") % 10 == 1, 1).otherwise(0))
    return context.changed_results(docs, now, "id").select("id", F.when(F.col("id") % 6 == 0, "gone").otherwise("changed").alias("outcome"))


@query(f"WITH {_DOCS} SELECT id, CASE WHEN starts_with(path, '/corpus/en/') THEN 17 END AS last_successful_sync, CASE WHEN starts_with(path, '/corpus/en/') THEN true WHEN starts_with(path, '/corpus/de/') THEN false END AS last_sync_complete FROM d")
def documents_with_reports(spark: SparkSession, sf: str) -> DataFrame:
    docs = corpus.corpus_documents(spark, sf).withColumn("root_path", F.regexp_extract("path", "^(/corpus/[^/]+)/", 1))
    reports = {"/corpus/en": {"successful_at_ms": 17, "complete": True}, "/corpus/de": {"complete": False}}
    return context.with_reports(docs, reports).select("id", F.col("last_successful_sync").cast("int").alias("last_successful_sync"), "last_sync_complete")


@query("""WITH s AS (SELECT conv_id, turn, sum(strlen(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS used FROM conversations)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, CAST(used AS BIGINT) AS used FROM s WHERE used <= 1000""")
def running_byte_budget(spark: SparkSession, sf: str) -> DataFrame:
    turns = corpus.table(spark, sf, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "text")
    return passages.within_budget(turns, "conv_id", "turn", "text", 1000).select("conv_id", "turn", "used")


@query()
def context_bundle(spark: SparkSession, sf: str) -> DataFrame:
    docs, blocks = _corpus(spark, sf)
    return context.bundle(docs, blocks, "the", limit=5)


@query(f"""WITH {_DOCS}, {_BLOCKS}, t AS ({_phrase_sql("the", order=f"{_ORDER} LIMIT 5")}),
p AS (SELECT t.id, t.path, t.rank, b.ordinal, b.content, row_number() OVER (PARTITION BY t.id ORDER BY b.ordinal) AS passage_no FROM t JOIN b ON b.document_id = t.id WHERE contains(lower(b.content), 'the'))
SELECT id || '-' || sha256(path)[1:16] AS reference, rank, passage_no, CAST(ordinal AS BIGINT) AS ordinal, content FROM p WHERE passage_no <= 3""")
def context_passages(spark: SparkSession, sf: str) -> DataFrame:
    """The passages of a context, one row each; the stored postings tell where to look."""
    index = corpus.indexed(spark, sf)
    rows = context.bundle(index.documents, index.blocks, "the", limit=5, candidates=candidates.candidates(index.postings, "the"))
    each = rows.select("reference", F.col("rank").cast("long").alias("rank"), F.explode("passages").alias("p"))
    return each.select("reference", "rank", F.col("p.passage_no").cast("long").alias("passage_no"), F.col("p.ordinal").cast("long").alias("ordinal"), "p.content")


from lodestone.plans import store_queries  # noqa: E402, F401  it registers its queries here
