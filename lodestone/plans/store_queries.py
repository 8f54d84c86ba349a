"""Queries over a real store: the table ``documents`` as files of a folder, listed, indexed, changed and indexed again; payloads and their sketches; paths of all platforms."""

from __future__ import annotations

import os
import shutil
from collections.abc import Iterator
from contextlib import suppress
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import paths
from lodestone.operators import maintain, search, sketches, stats
from lodestone.plans import context
from lodestone.plans.catalogue import _BLOCKS, _DOCS, _SPACE, _hits, _phrase_sql, query
from lodestone.plans.index import Index
from lodestone.plans.session import SearchSession
from lodestone.sources import corpus
from lodestone.sources.listing import scan_tree
from lodestone.sources.tables import modified, shared_dir, spread


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that the driver and all executors reach by path. Raises ValueError if the shared folder isn't one."""
    top = shared_dir(spark)
    if top.startswith("file:"):
        top = "/" + top[5:].lstrip("/")
    if not top.startswith("/"):
        raise ValueError(f"files need a shared folder with a path: {top}")
    folder = os.path.join(os.path.realpath(top), "lodestone", f"{name}-{os.urandom(6).hex()}")
    os.makedirs(folder)
    return folder


def write_files(files: DataFrame, root: str) -> int:
    """Writes files (path below the root, text, modified_at_ms) on the executors; a null text removes the file. Returns how many there were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, made = 0, set()
        for batch in batches:
            for path, text, at in zip(*(c.to_pylist() for c in batch.columns)):
                full = os.path.join(root, path)
                if text is None:
                    os.unlink(full)
                else:
                    if (folder := os.path.dirname(full)) not in made:
                        os.makedirs(folder, exist_ok=True)
                        made.add(folder)
                    Path(full).write_bytes(text.encode())
                    os.utime(full, ns=(int(at) * 1_000_000,) * 2)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return files.select("path", "text", "modified_at_ms").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def remove_files(files: DataFrame) -> None:
    """Deletes files (path) on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with suppress(FileNotFoundError):  # a task that is run again
                    os.unlink(path)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    spread(files.select("path")).mapInArrow(run, "n long").agg(F.sum("n")).first()


@dataclass
class Synced:
    root: str
    index: Index
    first: int
    second: int
    reports: list[dict]


def _files(spark: SparkSession, sf: str) -> DataFrame:
    docs = corpus.corpus_documents(spark, sf, F.coalesce("text", F.lit("")).alias("text"))
    return spread(docs.select("id", F.substring_index("path", "/corpus/", -1).alias("path"), "modified_at_ms", "text"), "id")


def synced(spark: SparkSession, sf: str) -> Synced:
    """The documents as files, indexed; then every tenth longer, every tenth gone and every tenth copied, and indexed again. Made once for each table and session."""
    known = spark.sparkContext.__dict__.setdefault("_lodestone_synced", {})
    key = sf, modified(spark, f"{sf}/documents.parquet")
    if key not in known:
        for old in [k for k in known if k[0] == sf]:
            shutil.rmtree(os.path.dirname(known.pop(old).root), ignore_errors=True)
        top = shared_folder(spark, "synced")
        root = os.path.join(top, "corpus")
        files = _files(spark, sf)
        write_files(files, root)
        index = Index.open(spark, os.path.join(top, "store"))
        reports = [index.sync(root)]
        first = index.number
        reports.append(index.sync(root))  # nothing has changed
        longer = files.where("id % 10 = 0").select("path", F.concat("text", F.lit("\nadded line")).alias("text"), "modified_at_ms")
        gone = files.where("id % 10 = 1").select("path", F.lit(None).cast("string").alias("text"), "modified_at_ms")
        copies = files.where("id % 10 = 2").select(F.concat(F.lit("copies/"), "path").alias("path"), "text", "modified_at_ms")
        write_files(longer.unionByName(gone).unionByName(copies), root)
        reports.append(index.sync(root))
        known[key] = Synced(root, index, first, index.number, reports)
    return known[key]


def _below(path: str, root: str) -> Column:
    return F.substring(F.col(path), len(root) + 2, 1 << 20)


_FILE = "substring(path, 9)"
_STATUS = f"CASE WHEN EXISTS (SELECT 1 FROM unnest(string_split_regex(coalesce(text, ''), '\\r\\n|\\n|\\r')) u(line) WHERE trim(line, {_SPACE}) <> '') THEN 'indexed' ELSE 'no_text' END"


@query(f"WITH {_DOCS} SELECT {_FILE} AS path, filename, extension, coalesce(size_bytes, 0) AS size_bytes, modified_at_ms FROM d")
def scan_listing(spark: SparkSession, sf: str) -> DataFrame:
    """The files of a tree, listed on the executors in several rounds."""
    root = os.path.join(shared_folder(spark, "scanned"), "corpus")
    write_files(_files(spark, sf), root)
    found = scan_tree(spark, root, most=100).files  # a table by now: the files have served
    remove_files(found)
    shutil.rmtree(os.path.dirname(root), ignore_errors=True)  # folders only, by now
    return found.select(_below("path", root).alias("path"), "filename", "extension", "size_bytes", "modified_at_ms")


@query(f"WITH {_DOCS} SELECT {_FILE} AS path, coalesce(size_bytes, 0) AS size_bytes, modified_at_ms, {_STATUS} AS status FROM d")
def store_first_sync(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of the snapshot of the first synchronisation."""
    made = synced(spark, sf)
    return made.index.store.table("documents", made.first).select(_below("path", made.root).alias("path"), "size_bytes", "modified_at_ms", "status")


@query(f"""WITH {_DOCS}, n AS (SELECT {_FILE} AS path, text || CASE WHEN id % 10 = 0 THEN chr(10) || 'added line' ELSE '' END AS text, TRUE AS kept FROM d WHERE id % 10 <> 1
UNION ALL SELECT 'copies/' || {_FILE}, text, FALSE FROM d WHERE id % 10 = 2)
SELECT path, strlen(coalesce(text, '')) AS size_bytes, kept, (SELECT count(*) FROM unnest(string_split_regex(coalesce(text, ''), '\\r\\n|\\n|\\r')) u(line) WHERE trim(line, {_SPACE}) <> '') AS blocks FROM n""")
def store_changed_sync(spark: SparkSession, sf: str) -> DataFrame:
    """Documents after files were changed, removed and added: whether they kept their id, and their blocks."""
    made = synced(spark, sf)
    store = made.index.store
    before = store.table("documents", made.first).select("path", F.col("id").alias("_before"))
    now = store.table("documents", made.second).join(before, "path", "left")
    blocks = store.table("blocks", made.second).groupBy("document_id").agg(F.count("*").alias("blocks"))
    found = now.join(blocks, now["id"] == blocks["document_id"], "left")
    return found.select(_below("path", made.root).alias("path"), "size_bytes", F.coalesce(F.col("id") == F.col("_before"), F.lit(False)).alias("kept"), F.coalesce("blocks", F.lit(0)).cast("long").alias("blocks"))


@query(f"""WITH {_DOCS}, c AS (SELECT count(*) AS n, count(*) FILTER (id % 10 = 0) AS longer, count(*) FILTER (id % 10 = 1) AS gone, count(*) FILTER (id % 10 = 2) AS copied FROM d)
SELECT * FROM (SELECT 1 AS run, n AS found, n AS added, 0 AS reprocessed, 0 AS unchanged, n AS parser_calls, 0 AS removed FROM c UNION ALL SELECT 2, n, 0, 0, n, 0, 0 FROM c
UNION ALL SELECT 3, n - gone + copied, copied, longer, n - gone - longer, longer + copied, gone FROM c)""")
def store_reports(spark: SparkSession, sf: str) -> DataFrame:
    """What three synchronisations report: the first, one without changes, one with some."""
    names = ["found", "added", "reprocessed", "unchanged", "parser_calls", "removed"]
    rows = [(k + 1, *(int(r[n]) for n in names)) for k, r in enumerate(synced(spark, sf).reports)]
    return spark.createDataFrame(rows, f"run int, {', '.join(f'{n} long' for n in names)}")


@query(f"WITH {_DOCS} SELECT {_FILE} AS path FROM d WHERE id % 10 = 0 OR (id % 10 <> 1 AND contains(lower(text), 'added line'))")
def store_search(spark: SparkSession, sf: str) -> DataFrame:
    """A search of the store after the changes, by its own postings."""
    made = synced(spark, sf)
    found = search.search(made.index.documents, made.index.blocks, "Added LINE", limit=None, candidates=made.index.candidates("Added LINE"))
    return found.select(_below("path", made.root).alias("path"))


_HIT = f"""h AS (SELECT *, row_number() OVER (ORDER BY named DESC, modified_at_ms DESC, path) AS first FROM (SELECT {_FILE} AS path, filename, modified_at_ms, text, contains(lower(filename), 'en') AS named FROM d
WHERE contains(lower(filename), 'en') OR contains(lower(text), 'en')))"""


@query(f"""WITH {_DOCS}, {_HIT}, r AS (SELECT path, row_number() OVER (ORDER BY first) AS position FROM h WHERE contains(lower(filename), 'the') OR contains(lower(text), 'the'))
SELECT path, position, (SELECT count(*) FROM r) AS total FROM r WHERE position BETWEEN 11 AND 20""")
def session_refined_page(spark: SparkSession, sf: str) -> DataFrame:
    """The second page of a session's second layer, read from stored layers of the first snapshot although others have been committed since."""
    made = synced(spark, sf)
    index = Index(made.index.store)
    index.number = made.first
    session = SearchSession(index, "en")
    session._check = lambda: None  # the snapshot isn't the current one any more, and is read all the same
    session.append("the")
    page = session.page(2, 10)
    return page.rows.select(_below("path", made.root).alias("path"), "position", F.lit(page.total).cast("long").alias("total"))


@query(f"""WITH {_DOCS}, h AS (SELECT {_FILE} AS path, filename, modified_at_ms, text FROM d WHERE id % 10 <> 1 UNION ALL SELECT 'copies/' || {_FILE}, filename, modified_at_ms, text FROM d WHERE id % 10 = 2),
t AS (SELECT * FROM h WHERE contains(lower(text), 'license') AND NOT contains(filename, 'license') ORDER BY modified_at_ms DESC, path LIMIT 5)
SELECT path, FALSE AS filename_only, least(3, (SELECT count(*) FROM unnest(string_split_regex(text, '\r\n|\n|\r')) u(line) WHERE contains(lower(line), 'license'))) AS passages FROM t""")
def selected_context(spark: SparkSession, sf: str) -> DataFrame:
    """The first five results of a session, selected and prepared for a context: checked again against index and files."""
    made = synced(spark, sf)
    session, selection = SearchSession(made.index, "license"), context.Selection()
    selection.toggle_page(session, 1, 5)
    rows = context.prepare(made.index, [("license", r) for r in selection.references])
    return spark.createDataFrame([(r["path"][len(made.root) + 1 :], r["filename_only"], len(r["passages"])) for r in rows], "path string, filename_only boolean, passages long")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR)), n_chars) AS k FROM documents WHERE n_chars IS NOT NULL)
SELECT lang, count(n_chars) AS n, quantile_disc(n_chars, 0.5) FILTER (k <= 40) AS p50, quantile_disc(n_chars, 0.95) FILTER (k <= 40) AS p95, max(n_chars) AS max FROM r GROUP BY lang""")
def profile_reservoir(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles from a reservoir of 40 values of each language."""
    return stats.sampled_percentiles(corpus.table(spark, sf, "documents"), "lang", "n_chars", F.col("doc_id"), 40)


# Payloads and sketches ------------------------------------------------------------------------------------------------

#: Bytes of a payload in these queries: small, so that documents have several.
SMALL = 1024
_FNV = "((xor(((xor(((xor(CAST({seed} AS BIGINT), unicode(g[1])) * 16777619) % 4294967296), unicode(g[2])) * 16777619) % 4294967296), unicode(g[3])) * 16777619) % 4294967296) % 8192"
_BITS = " UNION ".join(f"SELECT document_id, payload, {_FNV.format(seed=seed)} AS bit FROM g" for seed in sketches.SEEDS)
_PIECES = f"""{_BLOCKS}, x AS (SELECT document_id, ordinal, k, substring(lower(content), k * {SMALL} + 1, {SMALL}) AS piece, row_number() OVER (PARTITION BY document_id ORDER BY ordinal, k) AS row
  FROM (SELECT *, unnest(range((length(content) - 1) // {SMALL} + 1)) AS k FROM b)),
y AS (SELECT document_id, row, ordinal, piece, strlen(piece) AS held, 0 AS payload FROM x WHERE row = 1
  UNION ALL SELECT x.document_id, x.row, x.ordinal, x.piece, CASE WHEN y.held + strlen(x.piece) > {SMALL} THEN strlen(x.piece) ELSE y.held + strlen(x.piece) END,
    CASE WHEN y.held + strlen(x.piece) > {SMALL} THEN y.payload + 1 ELSE y.payload END FROM y JOIN x ON x.document_id = y.document_id AND x.row = y.row + 1)"""
_PAYLOAD_BITS = f"""{_PIECES}, z AS (SELECT document_id, payload, ordinal, string_agg(piece, '' ORDER BY row) AS text FROM y GROUP BY ALL),
g AS (SELECT DISTINCT document_id, payload, substring(text, i, 3) AS g FROM (SELECT *, unnest(range(1, length(text) - 1)) AS i FROM z)), p AS ({_BITS})"""


def _payloads(spark: SparkSession, sf: str) -> DataFrame:
    return sketches.payloads(corpus.indexed(spark, sf).blocks, SMALL)


@query(f"""WITH RECURSIVE {_PAYLOAD_BITS}, n AS (SELECT document_id, payload, count(*) AS bits FROM p GROUP BY ALL)
SELECT y.document_id, y.payload, CAST(sum(strlen(piece)) AS BIGINT) AS bytes, CAST(min(ordinal) AS INTEGER) AS first, CAST(max(ordinal) AS INTEGER) AS last, coalesce(any_value(n.bits), 0) AS bits
FROM y LEFT JOIN n ON n.document_id = y.document_id AND n.payload = y.payload GROUP BY y.document_id, y.payload""")
def payload_sketches(spark: SparkSession, sf: str) -> DataFrame:
    """Payloads of each document: bytes, the blocks they reach over, and bits set in their sketches."""
    return _payloads(spark, sf).select("document_id", "payload", "bytes", "first", "last", sketches.bits_set(F.col("sketch")).alias("bits"))


@query(f"""WITH {_BLOCKS}, g AS (SELECT DISTINCT document_id, 0 AS payload, substring(text, i, 3) AS g FROM (SELECT document_id, lower(content) AS text, unnest(range(1, length(content) - 1)) AS i FROM b)), p AS ({_BITS})
SELECT document_id, count(*) AS bits FROM p GROUP BY document_id""")
def document_sketch_bits(spark: SparkSession, sf: str) -> DataFrame:
    """Bits set in the sketch of each document."""
    found = sketches.document_sketches(corpus.indexed(spark, sf).blocks).select("document_id", sketches.bits_set(F.col("sketch")).alias("bits"))
    return found.where("bits > 0")


def _read_sql(term: str) -> str:
    """By document that may hold the term: payloads, and those that are read."""
    grams = sketches.term_bits(term)
    every = sorted({b for pair in grams for b in pair})
    worth = " OR ".join("(" + " AND ".join(f"list_contains(bits, {b})" for b in pair) + ")" for pair in grams)
    return f"""WITH RECURSIVE {_PAYLOAD_BITS}, l AS (SELECT document_id, payload, list(DISTINCT bit) AS bits FROM p GROUP BY ALL),
a AS (SELECT document_id, flatten(list(bits)) AS bits FROM l GROUP BY document_id),
c AS (SELECT document_id, payload FROM y GROUP BY ALL), m AS (SELECT document_id FROM a WHERE list_has_all(bits, {every})),
w AS (SELECT c.document_id, c.payload, coalesce({worth}, FALSE) AS worth FROM c LEFT JOIN l USING (document_id, payload) WHERE document_id IN (SELECT document_id FROM m))
SELECT document_id AS id, count(*) AS payloads, CASE WHEN bool_or(worth) THEN count(*) FILTER (worth) ELSE count(*) END AS read FROM w GROUP BY document_id"""


@query(_read_sql("license"))
def payloads_read(spark: SparkSession, sf: str) -> DataFrame:
    """By document that may match: how many payloads it has, and how many of them a search reads. Documents' sketches are those of all their payloads here."""
    held = _payloads(spark, sf)
    whole = held.groupBy("document_id").agg(*(F.bit_or(F.get("sketch", F.lit(k))).alias(f"w{k}") for k in range(sketches.SKETCH_BITS // 64)))
    whole = whole.select("document_id", F.array(*(f"w{k}" for k in range(sketches.SKETCH_BITS // 64))).alias("sketch"))
    documents = corpus.indexed(spark, sf).documents.join(whole.select(F.col("document_id").alias("id")), "id", "left_semi")
    read = sketches.reads(documents, whole, held, ["license"]).groupBy("id").agg(F.count("*").alias("read"))
    return held.groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("payloads")).join(read, "id").select("id", "payloads", "read")


@query(_phrase_sql("license"))
def search_by_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """A search that reads only payloads which may hold the phrase, checked exactly."""
    index = corpus.indexed(spark, sf)
    read = sketches.reads(index.documents, sketches.document_sketches(index.blocks), _payloads(spark, sf), ["license"])
    return _hits(search.search(index.documents, sketches.blocks_to_read(index.blocks, read), "license", limit=None))


# Paths of all platforms -----------------------------------------------------------------------------------------------

_MIXED = """m AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '/Data//' || lang || '/./x/../f' || doc_id WHEN 1 THEN 'D:\\備份\\' || upper(lang) || '\\.\\F' || doc_id WHEN 2 THEN 'd:/備份/' || lang || '/a/../f' || doc_id
  ELSE '\\\\Host\\Share\\' || lang || '\\F' || doc_id END AS path FROM documents)"""


def _mixed(spark: SparkSession, sf: str) -> DataFrame:
    docs, k, lang, n = corpus.table(spark, sf, "documents"), F.col("doc_id") % 4, F.col("lang"), F.col("doc_id").cast("string")
    path = F.when(k == 0, F.concat(F.lit("/Data//"), lang, F.lit("/./x/../f"), n)).when(k == 1, F.concat(F.lit("D:\\備份\\"), F.upper(lang), F.lit("\\.\\F"), n)).when(k == 2, F.concat(F.lit("d:/備份/"), lang, F.lit("/a/../f"), n))
    return docs.select("doc_id", path.otherwise(F.concat(F.lit("\\\\Host\\Share\\"), lang, F.lit("\\F"), n)).alias("path"), "lang")


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '/Data/' WHEN 3 THEN '//host/share/' ELSE 'd:/備份/' END || lang || '/f' || doc_id AS key FROM documents""")
def path_keys(spark: SparkSession, sf: str) -> DataFrame:
    """One key for each way to write a path of POSIX, a drive or a share."""
    return _mixed(spark, sf).select("doc_id", paths.path_key(F.col("path")).alias("key"))


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN CASE WHEN lang = 'en' THEN '\\\\HOST\\share\\EN\\' END WHEN doc_id % 4 = 0 THEN NULL WHEN lang = 'de' THEN 'D:\\備份\\De' ELSE 'd:\\' END AS root FROM documents""")
def windows_cover_join(spark: SparkSession, sf: str) -> DataFrame:
    """The most specific root that covers a path; Windows folders count whatever their case."""
    roots = spark.createDataFrame([("d:\\",), ("D:\\備份\\De",), ("\\\\HOST\\share\\EN\\",), ("/data",)], "root string")
    return maintain.covering_keys(_mixed(spark, sf), roots).select("doc_id", "root")


@query("SELECT doc_id FROM documents WHERE doc_id % 4 IN (1, 2) AND lang = 'fr'")
def windows_subtree(spark: SparkSession, sf: str) -> DataFrame:
    """The subtree filter of a search scope, on a Windows folder."""
    return _mixed(spark, sf).where(paths.below(F.col("path"), "D:\\備份\\FR")).select("doc_id")
