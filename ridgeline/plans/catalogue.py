"""The engine's operators as named queries over the test tables, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.functions import fixed, paths, text
from ridgeline.operators import chunking, dense, evaluation, lexical, ranking, registry, store
from ridgeline.plans import indexing
from ridgeline.plans import search as plan
from ridgeline.session import broadcast_if_small, fresh_dir, table
from ridgeline.streaming import changes

ROOT = "/work/trees/quill-index"
QUESTIONS = [(1, "expand scope member header"), (2, "loadScopeRusifi each visible cursor"), (3, "resolve_daemon unclaimed vector.table")]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """Distinct chunks; the table holds exact repeats."""
    return table(spark, d, "chunks").dropDuplicates(["project", "chunk_id"])


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _values(rows) -> str:
    lit = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(lit(x) if not isinstance(x, list) else _list(x) + "::VARCHAR[]" for x in r) + ")" for r in rows) + ")"


# The code points of Unicode white space, as a class for SQL patterns.
_WS = r"[\t\n\x{0b}\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_SQL_CHUNKS = "(SELECT DISTINCT project, chunk_id, path, ord, start_line, end_line, text, tokens, header FROM chunks)"
_SQL_TERMS = f"""
    l AS (SELECT project, chunk_id, list_concat(list_concat(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_$.]+'), list_transform(coalesce(tokens, []), lambda t: lower(t))),
                 regexp_extract_all(lower(coalesce(header, '')), '[\\p{{L}}\\p{{N}}_$.]+')) AS terms FROM {_SQL_CHUNKS})"""

# ---- text functions


@query("terms_scan", r"""
    SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9_$.]+')) AS term FROM (SELECT DISTINCT project, chunk_id, text FROM chunks)) GROUP BY 1""")
def terms_scan(spark: SparkSession, d: str) -> DataFrame:
    """How often each ASCII term stands in the chunks."""
    return _chunks(spark, d).select(F.explode(text.terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


_SQL_PARTS = r"list_transform(regexp_extract_all(regexp_replace({}, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[A-Z][a-z][a-z0-9]*|[A-Z]+|[a-z0-9]+'), lambda p: lower(p))"
_WORDS = ["parseUserConfig", "parse_user_config", "ParseUserConfig", "HTTPServer", "parseHTTPResponse", "pkg.Method", "$userName", "user2Config", "user", "config", "x", "CONFIG"]


@query("identifier_split", f"""
    WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z0-9_$.]+')) AS word FROM chunks UNION SELECT unnest({_list(_WORDS)})),
         p AS (SELECT word, {_SQL_PARTS.format("word")} AS parts FROM w)
    SELECT word, CASE WHEN len(parts) > 1 THEN array_to_string(parts, ' ') ELSE '' END AS parts FROM p""")
def identifier_split(spark: SparkSession, d: str) -> DataFrame:
    """The parts of every distinct term."""
    words = _chunks(spark, d).select(F.explode(text.terms(F.col("text"))).alias("word")).union(spark.createDataFrame([(w,) for w in _WORDS], "word string")).distinct()
    return words.select("word", F.array_join(text.split_identifier(F.col("word")), " ").alias("parts"))


@query("identifier_tokens", f"""
    WITH w AS (SELECT chunk_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9_$.]+'), lambda w: {_SQL_PARTS.format("w")}) AS a FROM (SELECT DISTINCT project, chunk_id, text FROM chunks)),
         p AS (SELECT chunk_id, flatten(list_filter(a, lambda x: len(x) > 1)) AS t FROM w)
    SELECT chunk_id, array_to_string(list_filter(t, lambda x, i: list_position(t, x) = i), ' ') AS tokens FROM p""")
def identifier_tokens(spark: SparkSession, d: str) -> DataFrame:
    """The distinct identifier parts of each chunk, as first seen."""
    return _chunks(spark, d).select("chunk_id", F.array_join(text.identifier_tokens(F.col("text")), " ").alias("tokens"))


@query("line_counts", "SELECT doc_id, length(text) - length(replace(text, chr(10), '')) + 1 AS n_lines FROM documents")
def line_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.line_count(F.col("text")).alias("n_lines"))


@query("end_lines", f"""
    SELECT chunk_id, greatest(start_line, start_line + length(text) - length(replace(text, chr(10), '')) - (text LIKE '%' || chr(10))::INT) AS last_line FROM {_SQL_CHUNKS}""")
def end_lines(spark: SparkSession, d: str) -> DataFrame:
    """The last line of each chunk, worked out from its start and body."""
    return _chunks(spark, d).select("chunk_id", text.end_line(F.col("start_line"), F.col("text")).alias("last_line"))


@query("sha_digest", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def sha_digest(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


@query("nonws_length", f"SELECT doc_id, length(regexp_replace(text, '{_WS}', '', 'g')) AS n FROM documents")
def nonws_length(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.ink_length(F.col("text")).alias("n"))


@query("fingerprints", f"SELECT doc_id, left(trim(regexp_replace(text, '{_WS}+', ' ', 'g')), 400) AS fp FROM documents")
def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.fingerprint(F.col("text")).alias("fp"))


@query("embed_texts", f"SELECT chunk_id, md5(CASE WHEN coalesce(header, '') <> '' THEN header || chr(10) || text ELSE text END) AS digest FROM {_SQL_CHUNKS}")
def embed_texts(spark: SparkSession, d: str) -> DataFrame:
    """A digest of what an embedder sees of each chunk."""
    return _chunks(spark, d).select("chunk_id", F.md5(text.embed_text(F.col("header"), F.col("text"))).alias("digest"))


# ---- path predicates

_PATHS = [
    ".env", "prod.env", "svc.env.enc", "laravel-env", ".env.example", "config/.env.template", "keys/id_rsa", "keys/id_rsa.pub", "a/b/server.key", "my-secret-map.json", "db_credentials.json",
    "node_modules/x/y.js", "packages/a/node_modules/z.ts", "src/vendor/lib.go", "src/vendors.go", "target/out.rs", "build", "a/build/x.py", "dist/app.js", "go.sum", "sub/Package-Lock.json", "x/gradlew",
    "app.min.js", "lib/app-min.css", "api.pb.go", "svc_pb2.py", "model.g.dart", "Form.Designer.cs", "poetry.lock", "data.csv", "notes.ipynb", "logo.svg", "img/photo.JPG", "doc.pdf", "m.parquet", "x.tar.gz",
    "Dockerfile", "ci/Jenkinsfile", "Makefile", "CMakeLists.txt", "a.tar", "weird.", ".hidden", "README.md", "src/app.py", "src/util.mjs", "conf/app.conf", "WORKSPACE", "x.unknown", "wiki/page.md", "docs/wiki/page.md",
]
_SQL_PATHS = f"p AS (SELECT DISTINCT path FROM files UNION SELECT unnest({_list(_PATHS)})), n AS (SELECT path, lower(string_split(path, '/')[-1]) AS name, lower(regexp_extract(string_split(path, '/')[-1], '[^.](\\.[^.]+)$', 1)) AS suffix FROM p)"
_EXCLUDE, _INCLUDE = ["wiki/*", "src/*.mjs", "vendor_portal/*"], ["src/util*", "*.env"]


def _globs(col: str, globs, slash: bool = True) -> str:
    return "(" + " OR ".join(f"{c} GLOB '{g}'" for g in globs for c in ((col, f"({col} || '/')") if slash else (col,))) + ")"


_SQL_VERDICT = {
    "secret": f"(NOT {_globs('name', fixed.SECRET_EXEMPT, False)} AND (name IN {tuple(fixed.SECRET_NAMES)} OR {_globs('name', fixed.SECRET_GLOBS, False)}))",
    "in_ignored_dir": f"list_has_any(list_slice(string_split(path, '/'), 1, len(string_split(path, '/')) - 1), {_list(fixed.IGNORE_DIRS)})",
    "ignored_name": f"name IN {tuple(fixed.IGNORE_NAMES)}",
    "default_ignored": _globs("path", fixed.DEFAULT_IGNORES),
    "image": f"suffix IN {tuple(fixed.IMAGE_SUFFIXES)}",
    "binary": f"suffix IN {tuple(fixed.BINARY_SUFFIXES)}",
}
_SQL_VERDICT["indexable"] = (
    f"NOT ({_globs('path', _EXCLUDE)} AND NOT {_globs('path', _INCLUDE)}) AND NOT ({_SQL_VERDICT['secret']}) AND NOT ({_SQL_VERDICT['image']}) AND NOT ({_SQL_VERDICT['binary']})"
    f" AND NOT ({_SQL_VERDICT['in_ignored_dir']}) AND NOT ({_SQL_VERDICT['ignored_name']}) AND NOT {_SQL_VERDICT['default_ignored']}"
)
_VERDICT = {
    "secret": lambda: paths.is_secret(F.col("path")), "in_ignored_dir": lambda: paths.in_ignored_dir(F.col("path")), "ignored_name": lambda: paths.is_ignored_name(F.col("path")),
    "default_ignored": lambda: paths.matches_any(F.col("path"), fixed.DEFAULT_IGNORES), "image": lambda: paths.is_image(F.col("path")), "binary": lambda: paths.is_binary_suffix(F.col("path")),
    "indexable": lambda: paths.indexable(F.col("path"), _EXCLUDE, _INCLUDE),
}


def _paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "files").select("path").union(spark.createDataFrame([(p,) for p in _PATHS], "path string")).distinct()


def _verdict(key: str, name: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _paths(spark, d).select("path", _VERDICT[name]().alias(name))

    query(key, f"WITH {_SQL_PATHS} SELECT path, {_SQL_VERDICT[name]} AS {name} FROM n")(run)


for _key, _name in (("secret_paths", "secret"), ("ignored_dirs", "in_ignored_dir"), ("ignored_names", "ignored_name"), ("default_globs", "default_ignored"),
                    ("image_paths", "image"), ("binary_paths", "binary"), ("indexable_filter", "indexable")):
    _verdict(_key, _name)

_SQL_LANG = f"""coalesce((SELECT l FROM {_values(fixed.NAME_LANGUAGE.items())} t(k, l) WHERE k = name), (SELECT l FROM {_values(fixed.SUFFIX_LANGUAGE.items())} s(k, l) WHERE k = suffix), '')"""


@query("lang_of_path", f"WITH {_SQL_PATHS} SELECT path, {_SQL_LANG} AS lang FROM n")
def lang_of_path(spark: SparkSession, d: str) -> DataFrame:
    return _paths(spark, d).select("path", paths.lang_of(F.col("path")).alias("lang"))


@query("store_keys", "SELECT DISTINCT project, string_split(project, '/')[-1] || '-' || left(sha256(project), 16) AS store FROM files")
def store_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "files").select("project").distinct().select("project", paths.store_key(F.col("project")).alias("store"))


# ---- store

_SQL_CURRENT = "(SELECT project, path, arg_max(struct_pack(sha := sha256, lang := lang, mtime := mtime, n_lines := n_lines), seen_at) AS r FROM files GROUP BY 1, 2)"
_SQL_STORED = """(SELECT project, path, x.sha FROM (SELECT s.project, s.path, arg_max(struct_pack(op := op, sha := s.sha256), (r.started_at, s.run_id, s.write_id)) AS x
    FROM (SELECT DISTINCT * FROM store_writes) s JOIN index_runs r ON s.run_id = r.run_id AND r.status = 'ok' GROUP BY 1, 2) WHERE x.op = 'write')"""


def _stored(spark: SparkSession, d: str) -> DataFrame:
    """(project, path, sha256) that the last successful runs left in the store."""
    runs = table(spark, d, "index_runs").where("status = 'ok'").select("run_id", "started_at")
    writes = table(spark, d, "store_writes").select("project", "path", "run_id", "write_id", "op", "sha256").join(broadcast_if_small(runs, 20_000), "run_id")
    last = writes.groupBy("project", "path").agg(F.max(F.struct("started_at", "run_id", "write_id", "op", "sha256")).alias("w"))
    return last.where("w.op = 'write'").select("project", "path", F.col("w.sha256").alias("sha256"))


@query("content_diff", f"""
    WITH c AS (SELECT project, path, r.sha AS sha FROM {_SQL_CURRENT} WHERE r.sha IS NOT NULL), s AS {_SQL_STORED}
    SELECT coalesce(c.project, s.project) AS project, coalesce(c.path, s.path) AS path, CASE WHEN c.path IS NULL THEN 'delete' ELSE 'write' END AS action
    FROM c FULL JOIN s ON c.project = s.project AND c.path = s.path WHERE c.sha IS DISTINCT FROM s.sha""")
def content_diff(spark: SparkSession, d: str) -> DataFrame:
    current = store.current_files(table(spark, d, "files")).select("project", "path", "sha256")
    return store.content_diff(current, _stored(spark, d))


@query("scoped_diff", f"""
    WITH c AS (SELECT project, path FROM {_SQL_CURRENT} WHERE r.sha IS NOT NULL), s AS {_SQL_STORED},
         n AS (SELECT DISTINCT project, path FROM files UNION SELECT DISTINCT project, path FROM store_writes),
         m AS (SELECT * FROM n WHERE path LIKE 'src/%')
    SELECT m.project, m.path, CASE WHEN c.path IS NOT NULL THEN 'write' ELSE 'delete' END AS action
    FROM m LEFT JOIN c ON m.project = c.project AND m.path = c.path LEFT JOIN s ON m.project = s.project AND m.path = s.path WHERE c.path IS NOT NULL OR s.path IS NOT NULL""")
def scoped_diff(spark: SparkSession, d: str) -> DataFrame:
    """The diff of the named paths (here: all under src)."""
    files, writes = table(spark, d, "files"), table(spark, d, "store_writes")
    named = files.select("project", "path").unionByName(writes.select("project", "path")).where(F.startswith("path", F.lit("src/")))
    return store.scoped_diff(store.current_files(files).select("project", "path", "sha256"), _stored(spark, d), named)


@query("apply_upsert", f"""
    WITH c AS (SELECT project, path, r.sha AS sha FROM {_SQL_CURRENT} WHERE r.sha IS NOT NULL), s AS {_SQL_STORED}
    SELECT project, path, sha AS sha256 FROM c UNION ALL SELECT s.project, s.path, s.sha FROM s ANTI JOIN c ON s.project = c.project AND s.path = c.path""")
def apply_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The store after writing all present files over it."""
    current = store.current_files(table(spark, d, "files")).where("sha256 is not null").select("project", "path", "sha256")
    return store.upsert(_stored(spark, d), current, ["project", "path"])


@query("delete_files", f"""
    WITH gone AS (SELECT project, path FROM {_SQL_CURRENT} WHERE r.sha IS NULL)
    SELECT c.project, c.chunk_id FROM {_SQL_CHUNKS} c ANTI JOIN gone g ON c.project = g.project AND c.path = g.path""")
def delete_files(spark: SparkSession, d: str) -> DataFrame:
    """The chunks that stay when those of files no longer readable go."""
    gone = store.current_files(table(spark, d, "files")).where("sha256 is null")
    return store.delete(_chunks(spark, d).select("project", "path", "chunk_id"), gone, ["project", "path"]).select("project", "chunk_id")


@query("relabel_lang", f"""
    WITH f AS (SELECT project, path, r.lang AS lang, lower(string_split(path, '/')[-1]) AS name, lower(regexp_extract(string_split(path, '/')[-1], '[^.](\\.[^.]+)$', 1)) AS suffix FROM {_SQL_CURRENT}),
         g AS (SELECT project, path, lang, {_SQL_LANG} AS new_lang FROM f)
    SELECT * FROM g WHERE lang IS DISTINCT FROM new_lang""")
def relabel_lang(spark: SparkSession, d: str) -> DataFrame:
    return store.relabelled(store.current_files(table(spark, d, "files")))


@query("orphan_check", """
    SELECT 'vector without chunk' AS kind, count(*) AS n FROM (SELECT DISTINCT chunk_id FROM chunks_vec) v ANTI JOIN chunks c ON v.chunk_id = c.chunk_id
    UNION ALL SELECT 'chunk without vector', count(*) FROM (SELECT DISTINCT chunk_id FROM chunks) c ANTI JOIN chunks_vec v ON v.chunk_id = c.chunk_id
    UNION ALL SELECT 'chunk without file', count(*) FROM (SELECT DISTINCT project, path, chunk_id FROM chunks) c ANTI JOIN files f ON c.project = f.project AND c.path = f.path
    UNION ALL SELECT 'file without chunk', count(*) FROM (SELECT DISTINCT project, path FROM files) f ANTI JOIN chunks c ON c.project = f.project AND c.path = f.path""")
def orphan_check(spark: SparkSession, d: str) -> DataFrame:
    """The integrity report of the three derived tables."""
    chunks, vectors, files = (table(spark, d, t) for t in ("chunks", "chunks_vec", "files"))
    n = lambda kind, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    key = ["project", "path"]
    return (
        n("vector without chunk", store.orphans(vectors, chunks, ["chunk_id"])).unionByName(n("chunk without vector", store.orphans(chunks, vectors, ["chunk_id"])))
        .unionByName(n("chunk without file", chunks.select(*key, "chunk_id").distinct().join(files.select(*key).distinct(), key, "left_anti")))
        .unionByName(n("file without chunk", store.orphans(files, chunks, key)))
    )


_SQL_COUNTS = "(SELECT coalesce(f.project, c.project) AS project, coalesce(f.n, 0) AS files, coalesce(c.n, 0) AS chunks FROM (SELECT project, count(DISTINCT path) AS n FROM files GROUP BY 1) f FULL JOIN (SELECT project, count(DISTINCT chunk_id) AS n FROM chunks GROUP BY 1) c ON f.project = c.project)"


@query("store_counts", f"SELECT * FROM {_SQL_COUNTS}")
def store_counts(spark: SparkSession, d: str) -> DataFrame:
    return store.counts(table(spark, d, "files"), table(spark, d, "chunks"))


_SCOPE = [ROOT, "/work/trees/quill-relay", "/work/trees/ember-index", "/work/trees/no-such-store"]


@query("scope_totals", f"SELECT count(*) AS projects, sum(files)::BIGINT AS files, sum(chunks)::BIGINT AS chunks FROM {_SQL_COUNTS} WHERE project IN {tuple(_SCOPE)}")
def scope_totals(spark: SparkSession, d: str) -> DataFrame:
    return plan.scope_totals(table(spark, d, "files"), table(spark, d, "chunks"), _SCOPE)


@query("last_run_status", "SELECT project, 'status' AS key, arg_max(status, (started_at, status)) AS value FROM index_runs GROUP BY 1")
def last_run_status(spark: SparkSession, d: str) -> DataFrame:
    """The last write of a key wins: here each project's newest run status."""
    meta = table(spark, d, "index_runs").select("project", F.lit("status").alias("key"), F.col("started_at").alias("ts"), F.col("status").alias("value"))
    return store.last_values(meta)


@query("suppressed_count", f"""
    SELECT project, greatest(0, count(*) FILTER (WHERE own) - count(*) FILTER (WHERE eff))::BIGINT AS suppressed
    FROM (SELECT project, NOT {_globs('path', ['docs/*'])} AS own, NOT {_globs('path', ['docs/*', '*.sql', 'vendor_portal/*'])} AS eff FROM (SELECT DISTINCT project, path FROM files)) GROUP BY 1""")
def suppressed_count(spark: SparkSession, d: str) -> DataFrame:
    """How many files inherited excludes take from each project."""
    p = F.col("path")
    return store.suppressed(table(spark, d, "files").select("project", "path").distinct(), ~paths.matches_any(p, ["docs/*"]), ~paths.matches_any(p, ["docs/*", "*.sql", "vendor_portal/*"]))


# ---- lexical lane

_INDEXED: dict[tuple[str, str], str] = {}


def _index(spark: SparkSession, d: str) -> str:
    """The lexical index of the chunks of `d`: written by the first search of a session that asks for it, and again if the table's files are others."""
    jvm = spark._jvm.org.apache.hadoop.fs
    at = jvm.Path(f"{d}/chunks.parquet")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files = [(s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in (fs.listStatus(at))]
    key = (spark.sparkContext.applicationId, f"{d} {sorted(files)}")
    if key not in _INDEXED:
        path = fresh_dir(spark, "lexical-index")
        lexical.write_index(table(spark, d, "chunks"), path)
        _INDEXED[key] = path
    return _INDEXED[key]


@query("index_chunks", f"WITH {_SQL_TERMS}, s AS (SELECT project, count(*) AS n_docs, avg(len(terms)) AS avgdl FROM l GROUP BY 1), p AS (SELECT project, count(*) AS postings, sum(tf)::BIGINT AS terms FROM (SELECT project, chunk_id, term, count(*) AS tf FROM (SELECT project, chunk_id, unnest(terms) AS term FROM l) GROUP BY 1, 2, 3) GROUP BY 1) SELECT project, n_docs, avgdl, coalesce(postings, 0) AS postings, coalesce(terms, 0) AS terms FROM s LEFT JOIN p USING (project)")
def index_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Write the lexical index and report what it holds of each project."""
    path = fresh_dir(spark, "lexical-index")
    lexical.write_index(table(spark, d, "chunks"), path)
    held = spark.read.parquet(f"{path}/postings").groupBy("project").agg(F.count(F.lit(1)).alias("postings"), F.sum("tf").alias("terms"))
    return spark.read.parquet(f"{path}/stats").join(held, "project", "left").fillna(0, ["postings", "terms"])


@query("postings_tf", f"WITH {_SQL_TERMS} SELECT project, chunk_id, term, count(*)::INT AS tf FROM (SELECT project, chunk_id, unnest(terms) AS term FROM l) GROUP BY 1, 2, 3")
def postings_tf(spark: SparkSession, d: str) -> DataFrame:
    return lexical.postings(table(spark, d, "chunks"))


@query("doc_freq", f"WITH {_SQL_TERMS} SELECT project, term, count(DISTINCT chunk_id) AS df FROM (SELECT project, chunk_id, unnest(terms) AS term FROM l) GROUP BY 1, 2")
def doc_freq(spark: SparkSession, d: str) -> DataFrame:
    lists = lexical.term_lists(table(spark, d, "chunks"))
    return lists.select("project", F.explode(F.array_distinct("terms")).alias("term")).groupBy("project", "term").agg(F.count(F.lit(1)).alias("df"))


@query("corpus_stats", f"WITH {_SQL_TERMS} SELECT project, count(*) AS n_docs, avg(len(terms)) AS avgdl FROM l GROUP BY 1")
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return lexical.corpus_stats(table(spark, d, "chunks"))


_TERMS = _values([(q, t) for q, s in QUESTIONS for t in text.query_terms(s)])
_SQL_BM25 = f"""{_SQL_TERMS},
    t AS (SELECT * FROM {_TERMS} v(qid, term)),
    st AS (SELECT project, count(*) AS n_docs, avg(len(terms)) AS avgdl FROM l GROUP BY 1),
    f AS (SELECT project, chunk_id, any_value(len(terms)) AS dl, term, count(*) AS f FROM (SELECT project, chunk_id, terms, unnest(terms) AS term FROM l) WHERE term IN (SELECT term FROM t) GROUP BY project, chunk_id, term),
    df AS (SELECT project, term, count(*) AS n_t FROM f GROUP BY 1, 2),
    w AS (SELECT project, term, avgdl, CASE WHEN ln((n_docs - n_t + 0.5) / (n_t + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_docs - n_t + 0.5) / (n_t + 0.5)) END AS idf FROM df JOIN st USING (project)),
    b AS (SELECT qid, f.project, chunk_id, -sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM f JOIN w USING (project, term) JOIN t USING (term) GROUP BY 1, 2, 3),
    lex AS (SELECT qid, project, chunk_id, score, row_number() OVER (PARTITION BY qid, project ORDER BY round(score, 9), chunk_id) - 1 AS pos FROM b)"""


def _queries(spark: SparkSession, d: str) -> DataFrame:
    """The questions with their terms, and for vectors those of the chunks with the smallest ids, read once a session."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _ASKED:
        v = table(spark, d, "chunks_vec").where(dense.usable(F.col("embedding"), 64)).groupBy("chunk_id").agg(F.max("embedding").alias("e")).orderBy("chunk_id").limit(len(QUESTIONS)).collect()
        _ASKED[key] = {q: list(r["e"]) for (q, _), r in zip(QUESTIONS, v)}
    return plan.make_queries(spark, QUESTIONS, _ASKED[key])


_ASKED: dict[tuple[str, str], dict[int, list[float]]] = {}


@query("bm25_scores", f"WITH {_SQL_BM25} SELECT qid, project, chunk_id, round(score, 9) AS score FROM b")
def bm25_scores(spark: SparkSession, d: str) -> DataFrame:
    return lexical.bm25_stored(spark, _index(spark, d), _queries(spark, d)).withColumn("score", F.round("score", 9))


@query("bm25_without_index", f"WITH {_SQL_BM25} SELECT qid, project, chunk_id, round(score, 9) AS score FROM b")
def bm25_without_index(spark: SparkSession, d: str) -> DataFrame:
    """The same scores from the texts, for tables that nobody has indexed."""
    return lexical.bm25(table(spark, d, "chunks"), _queries(spark, d)).withColumn("score", F.round("score", 9))


@query("bm25_topk_per_project", f"WITH {_SQL_BM25} SELECT qid, project, chunk_id, pos::INT AS pos FROM lex WHERE pos < 10")
def bm25_topk_per_project(spark: SparkSession, d: str) -> DataFrame:
    top = lexical.top_per_project(lexical.bm25_stored(spark, _index(spark, d), _queries(spark, d)), 10)
    return top.select("qid", "project", "chunk_id", F.col("pos").cast("int").alias("pos"))


@query("bm25_topk", f"WITH {_SQL_BM25} SELECT chunk_id, round(score, 9) AS score FROM b WHERE qid = 1 AND project = '{ROOT}' ORDER BY round(score, 9), chunk_id LIMIT 10")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten best of one question in one project: a sort with a limit, not a window."""
    scored = lexical.bm25_stored(spark, _index(spark, d), _queries(spark, d).where("qid = 1"), [ROOT])
    return scored.select("chunk_id", F.round("score", 9).alias("score")).orderBy("score", "chunk_id").limit(10)


# ---- dense lane

_SQL_KNN = f"""
    u AS (SELECT DISTINCT project, chunk_id, embedding::DOUBLE[] AS e FROM chunks_vec WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_max(list_transform(embedding, lambda x: abs(x))) > 0),
    qv AS (SELECT row_number() OVER (ORDER BY chunk_id) AS qid, max(e) AS v FROM u GROUP BY chunk_id ORDER BY chunk_id LIMIT {len(QUESTIONS)}),
    k AS (SELECT qid, project, chunk_id, 1 - list_cosine_similarity(e, v) AS distance FROM u, qv),
    den AS (SELECT qid, project, chunk_id, distance, row_number() OVER (PARTITION BY qid, project ORDER BY round(distance, 9), chunk_id) - 1 AS pos FROM k)"""


@query("knn_topk_per_project", f"WITH {_SQL_KNN} SELECT qid, project, chunk_id, round(distance, 6) AS distance FROM den WHERE pos < 10")
def knn_topk_per_project(spark: SparkSession, d: str) -> DataFrame:
    near = lexical.top_per_project(dense.knn(table(spark, d, "chunks_vec"), _queries(spark, d), 64, 10), 10, "distance")
    return near.select("qid", "project", "chunk_id", F.round("distance", 6).alias("distance"))


@query("knn_topk_per_label", """
    WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0),
         k AS (SELECT label, vec_id, 1 - list_cosine_similarity(embedding::DOUBLE[], v) AS distance FROM embeddings, q)
    SELECT label, vec_id, round(distance, 6) AS distance FROM k QUALIFY row_number() OVER (PARTITION BY label ORDER BY round(distance, 9), vec_id) <= 5""")
def knn_topk_per_label(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest of each label to one vector."""
    e = table(spark, d, "embeddings").select(F.col("label").cast("string").alias("project"), F.col("vec_id").alias("chunk_id"), "embedding")
    asked = e.where("chunk_id = 0").select(F.lit(1).alias("qid"), F.col("embedding").cast("array<double>").alias("vector"))
    near = lexical.top_per_project(dense.knn(e, asked, 64, 5), 5, "distance")
    return near.select(F.col("project").cast("int").alias("label"), F.col("chunk_id").alias("vec_id"), F.round("distance", 6).alias("distance"))


# ---- fusion and the whole search

_SQL_RRF = f"""{_SQL_BM25}, {_SQL_KNN},
    la AS (SELECT qid, project, chunk_id, 'bm25' AS lane, pos FROM lex WHERE pos < 60 UNION ALL SELECT qid, project, chunk_id, 'dense', pos FROM den WHERE pos < 60),
    rr AS (SELECT qid, project, chunk_id, round(sum(1.0::DOUBLE / (61 + pos)), 6) AS rrf, min(pos) FILTER (WHERE lane = 'bm25') AS bm25, min(pos) FILTER (WHERE lane = 'dense') AS dense FROM la GROUP BY 1, 2, 3)"""


@query("rrf_fusion", f"WITH {_SQL_RRF} SELECT qid, project, chunk_id, rrf, bm25::INT AS bm25, dense::INT AS dense FROM rr")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    lanes = plan.lanes(table(spark, d, "chunks"), table(spark, d, "chunks_vec"), _queries(spark, d), index=_index(spark, d))
    return ranking.rrf(lanes).select("qid", "project", "chunk_id", "rrf", "bm25", "dense")


def _sql_search(where: str = "TRUE", lanes: str = "", rerank: bool = False) -> str:
    # the pool in a new order: by the share of the query's terms that a hit's text holds
    held = "len(list_filter(terms, lambda t: list_contains(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_$.]+'), t)))"
    again = f"""h4 AS (SELECT h3.*, round({held} / greatest(len(terms), 1), 6) AS re FROM h3 JOIN (SELECT qid AS q, list(term) AS terms FROM {_TERMS} v(qid, term) GROUP BY 1) a ON a.q = h3.qid WHERE pool_pos < 60),
    h5 AS (SELECT * EXCLUDE (pool_pos), row_number() OVER (PARTITION BY qid ORDER BY re DESC, pool_pos) - 1 AS pool_pos FROM h4),"""
    pool, score = ("h5", "CASE WHEN re <> 0 THEN re ELSE rrf END") if rerank else ("h3", "rrf")
    return f"""WITH {_SQL_RRF.replace("la AS (", "la0 AS (").replace("FROM la GROUP", f"FROM la0 {lanes} GROUP")},
    ch AS {_SQL_CHUNKS}, lg AS (SELECT project, path, r.lang AS lang FROM {_SQL_CURRENT}),
    hits0 AS (SELECT rr.*, ch.path AS rel_path, start_line, end_line, text, lang, coalesce(bm25, 60 + dense) AS io, CASE WHEN rr.project = '{ROOT}' THEN '' ELSE rr.project END AS po
              FROM rr JOIN ch ON rr.project = ch.project AND rr.chunk_id = ch.chunk_id JOIN lg ON lg.project = ch.project AND lg.path = ch.path WHERE {where}),
    h1 AS (SELECT *, row_number() OVER (PARTITION BY qid, project ORDER BY rrf DESC, po, io) AS rn, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, po, io) AS g FROM hits0),
    h2 AS (SELECT *, min(g) OVER (PARTITION BY qid, project) AS best FROM h1),
    h3 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY
              CASE WHEN project = '{ROOT}' AND rn <= 30 THEN 0 ELSE 1 END, CASE WHEN project = '{ROOT}' AND rn > 30 THEN rn - 30 ELSE rn END,
              CASE WHEN project <> '{ROOT}' THEN best WHEN rn <= 30 THEN 0 ELSE 2147483647 END) - 1 AS pool_pos FROM h2),
    {again if rerank else ""}
    p AS (SELECT *, left(trim(regexp_replace(text, '{_WS}+', ' ', 'g')), 400) AS fp FROM {pool} WHERE pool_pos < 60),
    p1 AS (SELECT *, bool_or(project = '{ROOT}') OVER (PARTITION BY qid, rel_path, fp) AS root_has FROM p),
    p2 AS (SELECT * FROM p1 WHERE project = '{ROOT}' OR NOT root_has QUALIFY row_number() OVER (PARTITION BY qid, rel_path, fp ORDER BY pool_pos) = 1),
    p3 AS (SELECT *, row_number() OVER (PARTITION BY qid, project, rel_path ORDER BY pool_pos) > 2 AS held FROM p2),
    p4 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY held, pool_pos) AS rank FROM p3)
    SELECT qid, rank::INT AS rank, project, rel_path, chunk_lines AS lines, lang, {score} AS score FROM (SELECT *, start_line || '-' || end_line AS chunk_lines FROM p4) WHERE rank <= 10"""


def _shown(df: DataFrame) -> DataFrame:
    lines = F.concat(F.col("lines")[0].cast("string"), F.lit("-"), F.col("lines")[1].cast("string"))
    return df.select("qid", F.col("rank").cast("int").alias("rank"), "project", "rel_path", lines.alias("lines"), "lang", "score")


def _search(spark: SparkSession, d: str, rerank: bool = False, **options) -> DataFrame:
    return _shown(plan.search(table(spark, d, "chunks"), table(spark, d, "files"), table(spark, d, "chunks_vec"), _queries(spark, d), ROOT, rerank=rerank, index=_index(spark, d), **options))


@query("hybrid_search", _sql_search())
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: both lanes, fusion, pool cut, diversification and payload, for all questions in one plan."""
    return _search(spark, d)


@query("rerank_search", _sql_search(rerank=True))
def rerank_search(spark: SparkSession, d: str) -> DataFrame:
    """The flagship with its reranker, which is on by default."""
    return _search(spark, d, rerank=True)


@query("lexical_search", _sql_search(lanes="WHERE lane = 'bm25'"))
def lexical_search(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, mode="lexical")


@query("semantic_search", _sql_search(lanes="WHERE lane = 'dense'"))
def semantic_search(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, mode="semantic")


@query("post_filter_lang", _sql_search("lang = 'go'"))
def post_filter_lang(spark: SparkSession, d: str) -> DataFrame:
    """The language filter acts on the lanes' candidates, not before them."""
    return _search(spark, d, lang="go")


@query("post_filter_glob", _sql_search("(rel_path GLOB 'core/*' OR (rel_path || '/') GLOB 'core/*')"))
def post_filter_glob(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, path_glob="core/*")


@query("search_members", _sql_search(f"rr.project IN {tuple(_SCOPE)}"))
def search_members(spark: SparkSession, d: str) -> DataFrame:
    """A root with its members only; other projects' partitions aren't read."""
    return _search(spark, d, projects=_SCOPE)


# ---- the pooled hits

_SQL_HITS = "(SELECT qid, chunk_id, project, rel_path, start_line, end_line, lang, text, max(scores) AS scores FROM hits GROUP BY ALL)"


def _hits(spark: SparkSession, d: str) -> DataFrame:
    cols = ("project", "rel_path", "start_line", "end_line", "lang", "text")
    h = table(spark, d, "hits").groupBy("qid", "chunk_id", *cols).agg(F.max("scores").alias("scores"))
    order = F.coalesce(F.col("scores.bm25"), F.col("scores.dense") + 60, F.lit(999)).cast("long") * 1_000_000_000 + F.col("chunk_id")
    return h.withColumns({"rrf": F.coalesce(F.col("scores.rrf"), F.lit(0.0)), "project_ord": F.col("project"), "insert_ord": order})


_SQL_CUT = f"""
    h0 AS (SELECT *, coalesce(scores.rrf, 0) AS rrf, coalesce(scores.bm25, scores.dense + 60, 999)::BIGINT * 1000000000 + chunk_id AS io FROM {_SQL_HITS}),
    h1 AS (SELECT *, row_number() OVER (PARTITION BY qid, project ORDER BY rrf DESC, project, io) AS rn, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, project, io) AS g FROM h0),
    h2 AS (SELECT *, min(g) OVER (PARTITION BY qid, project) AS best, project = '{ROOT}' AS own FROM h1),
    h3 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN own AND rn <= 10 THEN 0 ELSE 1 END, CASE WHEN own AND rn > 10 THEN rn - 10 ELSE rn END,
              CASE WHEN NOT own THEN best WHEN rn <= 10 THEN 0 ELSE 2147483647 END) - 1 AS pool_pos FROM h2)"""


@query("pool_cut", f"WITH {_SQL_CUT} SELECT qid, chunk_id, pool_pos::INT AS pool_pos FROM h3 WHERE pool_pos < 20")
def pool_cut(spark: SparkSession, d: str) -> DataFrame:
    cut = ranking.pool_cut(_hits(spark, d), F.lit(ROOT), 20)
    return cut.select("qid", "chunk_id", F.col("pool_pos").cast("int").alias("pool_pos"))


@query("diversify", f"""WITH {_SQL_CUT},
    p AS (SELECT *, left(trim(regexp_replace(text, '{_WS}+', ' ', 'g')), 400) AS fp FROM h3),
    p1 AS (SELECT *, bool_or(own) OVER (PARTITION BY qid, rel_path, fp) AS root_has FROM p),
    p2 AS (SELECT * FROM p1 WHERE own OR NOT root_has QUALIFY row_number() OVER (PARTITION BY qid, rel_path, fp ORDER BY pool_pos) = 1),
    p3 AS (SELECT *, row_number() OVER (PARTITION BY qid, project, rel_path ORDER BY pool_pos) > 1 AS held FROM p2)
    SELECT qid, chunk_id, (row_number() OVER (PARTITION BY qid ORDER BY held, pool_pos))::INT AS rank FROM p3 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY held, pool_pos) <= 10""")
def diversify(spark: SparkSession, d: str) -> DataFrame:
    cut = ranking.pool_cut(_hits(spark, d), F.lit(ROOT), 1000)
    out = ranking.diversify(cut.where(F.lit(True)), F.lit(ROOT), 10, 1)
    return out.select("qid", "chunk_id", F.col("rank").cast("int").alias("rank"))


ORACLE["diversify"] = ORACLE["diversify"].replace("rn <= 10 THEN 0", "rn <= 500 THEN 0").replace("rn > 10 THEN rn - 10", "rn > 500 THEN rn - 500")


@query("payload_preview", f"""
    SELECT qid, chunk_id, project || '/' || rel_path AS path, CASE WHEN scores.rerank IS NOT NULL AND NOT isnan(scores.rerank) AND scores.rerank <> 0 THEN scores.rerank ELSE scores.rrf END AS score,
           array_to_string(list_slice(string_split(regexp_replace(regexp_replace(text, '\\r\\n|[\\n\\x{{0b}}\\f\\r\\x{{85}}\\x{{2028}}\\x{{2029}}]', chr(10), 'g'), '\\n$', ''), chr(10)), 1, 3), chr(10)) AS preview
    FROM {_SQL_HITS}""")
def payload_preview(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d).select(
        "qid", "chunk_id", F.concat_ws("/", "project", "rel_path").alias("path"), ranking.score(F.col("scores.rerank"), F.col("scores.rrf")).alias("score"), text.preview(F.col("text"), 3).alias("preview"))


# ---- registry

_RANK = "dense_rank() OVER (ORDER BY project)"
_SQL_REG = f"""(SELECT project AS path, i % 7 <> 3 AS enabled, i % 5 = 0 AS direct,
    CASE WHEN i % 5 = 0 THEN []::VARCHAR[] WHEN i % 3 = 0 THEN ['{ROOT}', '/work/trees/ember-index'] ELSE ['{ROOT}'] END AS roots, CASE WHEN i % 11 = 1 THEN 'failed' END AS last_error
    FROM (SELECT project, {_RANK} - 1 AS i FROM (SELECT DISTINCT project FROM files)))"""


def _registry(spark: SparkSession, d: str) -> DataFrame:
    """A registry made of the projects of `files`: by their number some are disabled, some roots, some members."""
    p = _numbered(table(spark, d, "files").select("project"), "project")
    roots = F.when(F.col("i") % 5 == 0, F.array().cast("array<string>")).when(F.col("i") % 3 == 0, F.array(F.lit(ROOT), F.lit("/work/trees/ember-index"))).otherwise(F.array(F.lit(ROOT)))
    return p.select(
        F.col("project").alias("path"), (F.col("i") % 7 != 3).alias("enabled"), (F.col("i") % 5 == 0).alias("direct"), roots.alias("roots"),
        F.when(F.col("i") % 11 == 1, "failed").alias("last_error"),
    )


def _numbered(rows: DataFrame, name: str) -> DataFrame:
    """The distinct values of a column with their number `i` in order: a registry's paths, so not many."""
    return rows.agg(F.array_sort(F.collect_set(name)).alias("a")).select(F.posexplode("a").alias("i", name))


@query("federation_members", f"SELECT DISTINCT root, path AS member FROM (SELECT unnest(roots) AS root, path FROM {_SQL_REG} WHERE enabled)")
def federation_members(spark: SparkSession, d: str) -> DataFrame:
    return registry.members(_registry(spark, d))


@query("expand_root", f"""
    WITH r AS {_SQL_REG}, m AS (SELECT DISTINCT root, path FROM (SELECT unnest(roots) AS root, path FROM r WHERE enabled)),
         a AS (SELECT root FROM m UNION SELECT path FROM r WHERE direct), u AS (SELECT root, root AS project, '' AS o FROM a UNION ALL SELECT root, path, path FROM m)
    SELECT root, project, (row_number() OVER (PARTITION BY root ORDER BY o) - 1)::INT AS ord FROM u""")
def expand_root(spark: SparkSession, d: str) -> DataFrame:
    return registry.expand(_registry(spark, d)).withColumn("ord", F.col("ord").cast("int"))


_CONFIGS = [(ROOT, ["wiki/*", "*.sql"], ["wiki/keep/*"], 0, 1), ("/work/trees/ember-index", ["docs/*", "*.sql"], [], 0, 0), ("/work/trees/quill-relay", ["b/*", "a/*"], ["a/z"], 0, 0)]


@query("config_union", f"""
    WITH r AS {_SQL_REG}, c AS (SELECT path, ex, inc, rg = 1 AS rg, ud = 1 AS ud FROM {_values(_CONFIGS)} v(path, ex, inc, rg, ud)),
         x AS (SELECT r.path, coalesce(ex, []) AS ex, coalesce(inc, []) AS inc, coalesce(rg, true) AS rg, coalesce(ud, true) AS ud FROM r LEFT JOIN c ON r.path = c.path
               UNION ALL SELECT q.path, ex, []::VARCHAR[], rg, ud FROM (SELECT path, unnest(roots) AS root FROM r) q JOIN c ON c.path = q.root WHERE q.root <> q.path)
    SELECT path, array_to_string(list_sort(list_distinct(flatten(list(ex)))), ',') AS exclude, array_to_string(list_sort(flatten(list(inc))), ',') AS include, bool_or(rg) AS respect_gitignore, bool_or(ud) AS use_default_ignores
    FROM x GROUP BY 1""")
def config_union(spark: SparkSession, d: str) -> DataFrame:
    configs = spark.createDataFrame([(p, e, i, bool(r), bool(u)) for p, e, i, r, u in _CONFIGS], "path string, exclude array<string>, include array<string>, respect_gitignore boolean, use_default_ignores boolean")
    out = registry.effective_config(_registry(spark, d), configs)
    return out.withColumns({"exclude": F.array_join("exclude", ","), "include": F.array_join("include", ",")})


@query("owner_longest_prefix", """
    WITH f AS (SELECT DISTINCT project || '/' || path AS path FROM files), p AS (SELECT DISTINCT project AS p FROM files UNION SELECT DISTINCT project || '/src' FROM files)
    SELECT f.path, arg_max(p, length(p)) AS owner FROM f LEFT JOIN p ON f.path = p OR starts_with(f.path, p || '/') GROUP BY 1""")
def owner_longest_prefix(spark: SparkSession, d: str) -> DataFrame:
    """The owning project of every full path; nested projects win."""
    f = table(spark, d, "files")
    projects = f.select(F.col("project").alias("path")).union(f.select(F.concat("project", F.lit("/src")))).distinct()
    return registry.owners(f.select(F.concat_ws("/", "project", "path").alias("path")).distinct(), projects)


@query("fleet_digest", f"""
    WITH r AS (SELECT sha256(path || '|' || enabled || '|' || direct || '|' || array_to_string(list_sort(roots), ',') || '|' || (last_error IS NOT NULL)) AS d FROM {_SQL_REG}),
         g AS (SELECT left(d, 4) || sha256(array_to_string(list_sort(list(d)), chr(10))) AS x FROM r GROUP BY left(d, 4))
    SELECT left(sha256(array_to_string(list_sort(list(x)), chr(10))), 16) AS digest FROM g""")
def fleet_digest(spark: SparkSession, d: str) -> DataFrame:
    return registry.fleet_digest(_registry(spark, d))


@query("backup_retention", """
    SELECT project, name FROM (SELECT project, 'projects.json.' || lpad(run_id::VARCHAR, 8, '0') AS name FROM index_runs)
    QUALIFY row_number() OVER (PARTITION BY project ORDER BY name DESC) > 5""")
def backup_retention(spark: SparkSession, d: str) -> DataFrame:
    """Backups beyond the newest five of each project."""
    names = table(spark, d, "index_runs").select("project", F.concat(F.lit("projects.json."), F.lpad(F.col("run_id").cast("string"), 8, "0")).alias("name"))
    return registry.stale_backups(names, 5)


@query("unclaimed", f"""
    WITH r AS (SELECT path FROM {_SQL_REG}), s AS (SELECT string_split(project, '/')[-1] || '-' || left(sha256(project), 16) AS store, max(mtime) AS newest, floor(sum(size) / 1048576)::BIGINT AS mib FROM files GROUP BY 1)
    SELECT store, mib FROM (SELECT * FROM s UNION ALL SELECT 'gone-0123456789abcdef', 0.0, 0) WHERE store NOT IN (SELECT string_split(path, '/')[-1] || '-' || left(sha256(path), 16) FROM r) AND 1800000000.0 - newest > 60""")
def unclaimed(spark: SparkSession, d: str) -> DataFrame:
    """Idle store folders that no row of the registry claims; one folder is left of a project that isn't registered any more."""
    left = spark.createDataFrame([("gone-0123456789abcdef", 0.0, 0)], "store string, mtime double, size long")
    stores = table(spark, d, "files").select(paths.store_key(F.col("project")).alias("store"), "mtime", "size").union(left)
    return registry.prunable(stores, _registry(spark, d), 1_800_000_000.0)


@query("registry_claims", f"SELECT count(*) FILTER (WHERE enabled) AS enabled, count(*) FILTER (WHERE NOT direct AND len(roots) = 0) AS unclaimed FROM {_SQL_REG}")
def registry_claims(spark: SparkSession, d: str) -> DataFrame:
    """How many projects are enabled, and how many rows nobody claims."""
    return registry.health(_registry(spark, d))


@query("member_sweep", f"""
    WITH found AS (SELECT DISTINCT project AS member, '{ROOT}' AS root FROM files WHERE project <> '{ROOT}')
    SELECT f.member, f.root FROM found f ANTI JOIN (SELECT path, unnest(roots) AS root FROM {_SQL_REG}) c ON f.member = c.path AND f.root = c.root""")
def member_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Members found that don't carry the root's claim yet."""
    found = table(spark, d, "files").where(F.col("project") != ROOT).select(F.col("project").alias("member"), F.lit(ROOT).alias("root")).distinct()
    claims = _registry(spark, d).select(F.col("path").alias("member"), F.explode("roots").alias("root"))
    return found.join(claims, ["member", "root"], "left_anti").select("member", "root")


# ---- evaluation


_SQL_RANKS = f"""
    hh AS (SELECT qid, chunk_id, scores FROM {_SQL_HITS}),
    best AS (SELECT qid, arg_max(chunk_id, (coalesce(scores.rrf, 0), -chunk_id)) AS positive FROM hh GROUP BY 1),
    ranks AS (SELECT 'lexical' AS arm, b.qid, min(scores.bm25 + 1) AS rank FROM best b LEFT JOIN hh ON b.qid = hh.qid AND b.positive = hh.chunk_id GROUP BY b.qid
              UNION ALL SELECT 'semantic', b.qid, min(scores.dense + 1) FROM best b LEFT JOIN hh ON b.qid = hh.qid AND b.positive = hh.chunk_id GROUP BY b.qid
              UNION ALL SELECT 'other', b.qid, CASE WHEN b.qid % 3 = 0 THEN NULL ELSE min(scores.bm25 + 9) END FROM best b LEFT JOIN hh ON b.qid = hh.qid AND b.positive = hh.chunk_id GROUP BY b.qid)"""


def _ranks(spark: SparkSession, d: str) -> DataFrame:
    """(arm, qid, rank): the place of each search's best fused hit in the two lanes, and a third, worse arm."""
    h = _hits(spark, d)
    best = h.groupBy("qid").agg(F.max_by("chunk_id", F.struct("rrf", -F.col("chunk_id"))).alias("chunk_id"))
    own = best.join(h, ["qid", "chunk_id"]).groupBy("qid").agg(F.min("scores.bm25").alias("b"), F.min("scores.dense").alias("d"))
    arms = F.array(
        F.struct(F.lit("lexical").alias("arm"), (F.col("b") + 1).alias("rank")), F.struct(F.lit("semantic").alias("arm"), (F.col("d") + 1).alias("rank")),
        F.struct(F.lit("other").alias("arm"), F.when(F.col("qid") % 3 != 0, F.col("b") + 9).alias("rank")),
    )
    return own.select("qid", F.explode(arms).alias("a")).select("a.arm", "qid", "a.rank")


@query("eval_metrics", f"""WITH {_SQL_RANKS}
    SELECT arm, count(*) AS n, round(sum((rank = 1 IS TRUE)::INT) / count(*), 4) AS recall_at_1, round(sum((rank <= 10 IS TRUE)::INT) / count(*), 4) AS recall_at_10, round(sum(coalesce(1.0::DOUBLE / rank, 0)) / count(*), 4) AS mrr FROM ranks GROUP BY 1""")
def eval_metrics(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.metrics(_ranks(spark, d))


ORACLE["eval_metrics"] = ORACLE["eval_metrics"].replace("(rank = 1 IS TRUE)", "coalesce(rank = 1, false)").replace("(rank <= 10 IS TRUE)", "coalesce(rank <= 10, false)")
_SQL_DISC = f"""{_SQL_RANKS},
    a AS (SELECT arm, qid, coalesce(rank <= 10, false)::INT AS h FROM ranks),
    dis AS (SELECT x.arm, count(*) AS pairs, count(*) FILTER (WHERE x.h > y.h) AS won, count(*) FILTER (WHERE x.h < y.h) AS lost, round(avg(x.h - y.h), 4) AS delta FROM a x JOIN a y ON x.qid = y.qid AND y.arm = 'lexical' WHERE x.arm <> 'lexical' GROUP BY 1)"""


@query("paired_discordance", f"WITH {_SQL_DISC} SELECT * FROM dis")
def paired_discordance(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.discordance(_ranks(spark, d), "lexical")


_SQL_P = """pv AS (SELECT arm, won, lost, CASE WHEN won + lost = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(won, lost) + 1),
    lambda i: exp(lgamma(won + lost + 1) - lgamma(i + 1) - lgamma(won + lost - i + 1) - (won + lost) * ln(2.0))))) END AS p FROM dis)"""


@query("mcnemar", f"WITH {_SQL_DISC}, {_SQL_P} SELECT arm, won, lost, round(p, 9) AS p FROM pv")
def mcnemar(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.mcnemar(evaluation.discordance(_ranks(spark, d), "lexical")).select("arm", "won", "lost", F.round("p", 9).alias("p"))


@query("bh_adjust", """
    WITH t AS (SELECT event_type, user_id, (1 + max(event_id) % 997) / 1000.0::DOUBLE AS p FROM events GROUP BY 1, 2),
         r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY p, user_id) AS k, count(*) OVER (PARTITION BY event_type) AS m FROM t)
    SELECT event_type, user_id, p, round(least(1.0, min(p * m / k) OVER (PARTITION BY event_type ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 9) AS p_adjusted FROM r""")
def bh_adjust(spark: SparkSession, d: str) -> DataFrame:
    """Adjusted p-values, a family per event type."""
    t = table(spark, d, "events").groupBy("event_type", "user_id").agg(((F.max("event_id") % 997 + 1) / 1000.0).alias("p"))
    return evaluation.adjust(t, "p", "event_type").withColumn("p_adjusted", F.round("p_adjusted", 9))


@query("bootstrap_ci")
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    """Intervals from resampled queries; rows only, for they depend on the random numbers."""
    return evaluation.bootstrap(_ranks(spark, d), "lexical")


@query("round_robin_stratify", """
    WITH f AS (SELECT lang, project, path FROM (SELECT project, path, arg_max(lang, (seen_at, lang)) AS lang FROM files GROUP BY 1, 2)),
         r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY path, project) AS rn FROM f)
    SELECT lang, project, path FROM r ORDER BY rn, lang LIMIT 60""")
def round_robin_stratify(spark: SparkSession, d: str) -> DataFrame:
    """Sixty files, one of each language a round."""
    f = table(spark, d, "files").groupBy("project", "path").agg(F.max_by("lang", F.struct("seen_at", "lang")).alias("lang"))
    return evaluation.round_robin(f.withColumn("key", F.struct("path", "project")), "lang", "key", 60).select("lang", "project", "path")


@query("derived_queries")
def derived_queries(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation queries from the documentation that documents begin with; the line scanners have no SQL form."""
    docs = table(spark, d, "documents").where("text is not null").select(F.coalesce("source", F.lit("")).alias("project"), "path", "lang", "text")
    return evaluation.derive_queries(docs).select("project", "positive", "lang", "query", F.length("stripped").alias("left"))


@query("latency_percentiles", """
    WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
    SELECT event_type, any_value(n) AS n, median(value) AS median, min(value) FILTER (WHERE k = greatest(floor(n * 0.95) - 1, 0) + 1) AS p95 FROM r GROUP BY 1""")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.percentiles(table(spark, d, "events"), "event_type", "value")


# ---- the write path, over the documents as files of their sources

_INKED = "regexp_matches(text, '[^" + _WS[1:] + "')"
_LATER = "text || chr(10) || 'edited'"


def _tree(docs: DataFrame) -> DataFrame:
    """The documents that aren't blank as a listing of files, a project a source."""
    inked = docs.where(F.col("text").rlike(r"(?U)\S"))
    return inked.select(
        F.coalesce("source", F.lit("")).alias("project"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.lit(0.0).alias("mtime"),
        F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("sha256"), F.lit("").alias("lang"), text.line_count(F.col("text")).cast("int").alias("n_lines"), "text",
    )


def _edited(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("text").rlike(r"(?U)\S")).withColumn("text", F.concat("text", F.lit("\nedited")))


def _store(spark: SparkSession) -> indexing.Store:
    return indexing.Store(spark, fresh_dir(spark, "store"))


def _held(s: indexing.Store) -> DataFrame:
    """(project, path, sha256, joined, chunks_fit): each file of a store, a digest of its chunks joined, and whether each is within the limit."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"])
    bodies = s.chunks().groupBy("project", "path").agg(F.sha2(F.array_join(parts, ""), 256).alias("joined"), (F.max("n_chars") <= fixed.CHUNK_CHARS).alias("chunks_fit"))
    return s.files().select("project", "path", "sha256").join(bodies, ["project", "path"], "left")


def _sql_held(text: str = "text", where: str = "TRUE") -> str:
    return f"SELECT coalesce(source, '') AS project, 'd' || doc_id AS path, sha256({text}) AS sha256, sha256({text}) AS joined, TRUE AS chunks_fit FROM documents WHERE {_INKED} AND {where}"


@query("index_pass", _sql_held())
def index_pass(spark: SparkSession, d: str) -> DataFrame:
    """Index all documents: files, chunks that joined are the file again, vectors and postings."""
    s = _store(spark)
    s.index(_tree(table(spark, d, "documents")))
    return _held(s)


@query("index_second_pass", f"SELECT 0 AS written, 0 AS deleted, 0 AS relabelled, count(*) AS files, 1 AS generations FROM documents WHERE {_INKED}")
def index_second_pass(spark: SparkSession, d: str) -> DataFrame:
    """A pass over unchanged documents writes nothing."""
    s = _store(spark)
    s.index(_tree(table(spark, d, "documents")))
    done = s.index(_tree(table(spark, d, "documents")))
    return spark.createDataFrame([(done.written, done.deleted, done.relabelled, done.files, len(s.commits()))], "written int, deleted int, relabelled int, files long, generations int")


@query("index_edit_delete", _sql_held(f"CASE WHEN lang = 'python' THEN {_LATER} ELSE text END", "lang IS DISTINCT FROM 'go'"))
def index_edit_delete(spark: SparkSession, d: str) -> DataFrame:
    """A pass after the Python documents were edited and the Go documents are gone."""
    s, docs = _store(spark), table(spark, d, "documents")
    s.index(_tree(docs))
    python = F.coalesce(F.col("lang") == "python", F.lit(False))
    left = docs.where(~F.coalesce(F.col("lang") == "go", F.lit(False)))
    projects = sorted(r["p"] for r in docs.select(F.coalesce("source", F.lit("")).alias("p")).distinct().collect())  # a row a source
    s.index(_tree(_edited(left.where(python)).unionByName(left.where(~python))), projects=projects)
    return _held(s)


@query("index_scoped", _sql_held(f"CASE WHEN lang = 'python' THEN {_LATER} ELSE text END"))
def index_scoped(spark: SparkSession, d: str) -> DataFrame:
    """Every document was edited, but only the Python ones are named to the pass."""
    s, docs = _store(spark), table(spark, d, "documents")
    s.index(_tree(docs))
    s.index(_tree(_edited(docs)), named=_tree(docs.where("lang = 'python'")).select("project", "path"))
    return _held(s)


@query("index_compacted", _sql_held(f"CASE WHEN lang = 'python' THEN {_LATER} ELSE text END"))
def index_compacted(spark: SparkSession, d: str) -> DataFrame:
    """The same store after its generations were written as one."""
    s, docs = _store(spark), table(spark, d, "documents")
    s.index(_tree(docs))
    s.index(_tree(_edited(docs)), named=_tree(docs.where("lang = 'python'")).select("project", "path"))
    s.compact()
    return _held(s)


# Bytes and the text they are read as.
_BYTES = [("6f6b", "ok"), ("fffe", "\ufffd\ufffd"), ("61e282", "a\ufffd"), ("c3a9", "é"), ("", "")]


@query("decode", f"SELECT * FROM {_values(_BYTES)} v(bytes, text)")
def decode(spark: SparkSession, d: str) -> DataFrame:
    """Text of bytes, invalid sequences replaced."""
    return spark.createDataFrame([(b,) for b, _ in _BYTES], "bytes string").select("bytes", text.decoded(F.unhex("bytes")).alias("text"))


@query("stripped_corpus", "SELECT doc_id, TRUE AS kept FROM documents WHERE text IS NOT NULL")
def stripped_corpus(spark: SparkSession, d: str) -> DataFrame:
    """Every document stays in the corpus, and what is left of it is its end."""
    docs = table(spark, d, "documents").where("text is not null").select(F.lit("all").alias("project"), F.col("doc_id").cast("string").alias("path"), "lang", "text")
    left = evaluation.stripped_corpus(docs).select("path", F.col("text").alias("left"))
    return docs.join(left, "path").select(F.col("path").cast("long").alias("doc_id"), F.endswith("text", F.col("left")).alias("kept"))


@query("corpora_overlap", "SELECT DISTINCT project, path FROM files WHERE FALSE")
def corpora_overlap(spark: SparkSession, d: str) -> DataFrame:
    """The files that are in the code corpus and in the prose corpus: none."""
    f = table(spark, d, "files").select("project", "path", paths.lang_of(F.col("path")).alias("lang"))
    prose = F.col("lang").isin(list(fixed.DOC_LANGUAGES))
    return evaluation.overlap(f.where(~prose), f.where(prose))


# ---- chunking and the change feed


@query("chunk_documents", "SELECT count(*) AS documents, 0 AS lossy, 0 AS bad_lines, 0 AS too_large FROM documents WHERE regexp_matches(text, '[^" + _WS[1:] + "')")
def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    """Chunk every document and count those that aren't the file again, whose lines don't resolve, or with a chunk above the limit."""
    docs = table(spark, d, "documents").select(F.lit("all").alias("project"), F.col("doc_id").cast("string").alias("path"), "text").where(F.col("text").rlike(r"(?U)\S"))
    chunks = chunking.chunk_files(docs)
    whole = chunks.groupBy("path").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "").alias("joined"),
        F.max("end_line").alias("last"), F.max("n_chars").alias("most"),
    )
    both = docs.join(whole, "path", "left")
    lines = F.greatest(F.lit(1), text.line_count(F.col("text")) - F.endswith("text", F.lit("\n")).cast("int"))
    return both.agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(~F.col("joined").eqNullSafe(F.col("text"))).alias("lossy"),
        F.count_if(~F.col("last").eqNullSafe(lines)).alias("bad_lines"), F.count_if(F.col("most") > fixed.CHUNK_CHARS).alias("too_large"),
    )


@query("stream_change_batches", """
    WITH e AS (SELECT DISTINCT '/work/p' || (user_id % 20) AS project, event_type || '/e' || (event_id % 500) || '.py' AS rel  FROM events)
    SELECT project, array_to_string(list_sort(list(rel)), ',') AS paths FROM e GROUP BY 1""")
def stream_change_batches(spark: SparkSession, d: str) -> DataFrame:
    """The events as a change feed, read as a stream in one go: paths grouped to a job per owning project."""
    events = table(spark, d, "events")
    out = fresh_dir(spark, "jobs")
    stream = spark.readStream.schema(events.schema).parquet(f"{d}/events.parquet" if _is_dir(spark, f"{d}/events.parquet") else f"{d}/event[s].parquet")
    projects = spark.createDataFrame([(f"/work/p{i}",) for i in range(20)], "path string")
    feed = stream.select(F.concat(F.lit("/work/p"), F.col("user_id") % 20, F.lit("/"), "event_type", F.lit("/e"), F.col("event_id") % 500, F.lit(".py")).alias("path"))

    def batch(df: DataFrame, number: int) -> None:
        changes.jobs(df, projects).write.mode("overwrite").parquet(f"{out}/batches/batch={number}")

    feed.writeStream.foreachBatch(batch).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    done = spark.read.parquet(f"{out}/batches").select("project", F.explode("paths").alias("p")).distinct()  # a path may come in several batches
    return done.groupBy("project").agg(F.array_join(F.array_sort(F.collect_list("p")), ",").alias("paths"))


def _is_dir(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


@query("event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """An extension of the change feed: counts by hour of event time."""
    return changes.windowed_counts(table(spark, d, "events"))


@query("queue_dedup", """
    WITH q AS (SELECT event_id AS seq, user_id AS project, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS paths FROM events)
    SELECT min(seq) AS seq, project, NULL AS paths FROM q WHERE paths IS NULL GROUP BY project UNION ALL SELECT seq, project, paths FROM q WHERE paths IS NOT NULL""")
def queue_dedup(spark: SparkSession, d: str) -> DataFrame:
    """A job queue without repeated whole-project jobs."""
    q = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("project"), F.when(F.col("event_id") % 3 != 0, F.array("event_type")).alias("paths"))
    return changes.coalesce_jobs(q).withColumn("paths", F.array_join("paths", ","))


@query("census_top", "SELECT '/home/u' || user_id AS cwd, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, cwd LIMIT 10")
def census_top(spark: SparkSession, d: str) -> DataFrame:
    """The ten working folders named most."""
    from ridgeline.sources import corpus

    return corpus.most_common(table(spark, d, "events").select(F.concat(F.lit("/home/u"), "user_id").alias("cwd")))


@query("first_seen", "SELECT user_id, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY 1")
def first_seen(spark: SparkSession, d: str) -> DataFrame:
    """The first event of each user."""
    from ridgeline.sources import corpus

    return corpus.first_seen(table(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("census", """
    WITH p AS (SELECT DISTINCT project AS p FROM files), c AS (SELECT DISTINCT '/work/trees/' || string_split(project, '/')[-1] || CASE WHEN event_id % 3 = 0 THEN '' ELSE '/sub/x' END AS cwd FROM (SELECT event_id, user_id FROM events) e,
              (SELECT project, dense_rank() OVER (ORDER BY project) AS i FROM (SELECT DISTINCT project FROM files)) f WHERE f.i = e.user_id % 60 UNION SELECT DISTINCT '/home/u' || user_id FROM events),
         o AS (SELECT cwd, max(p) AS own FROM c LEFT JOIN p ON cwd = p OR starts_with(cwd, p || '/') GROUP BY 1)
    SELECT CASE WHEN own IS NULL THEN 'unresolved' WHEN own = cwd THEN 'direct' ELSE 'resolves-up' END AS how, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM o), 1) AS percent FROM o GROUP BY 1""")
def census(spark: SparkSession, d: str) -> DataFrame:
    """How working folders resolve to projects."""
    from ridgeline.sources import corpus

    projects = table(spark, d, "files").select(F.col("project").alias("path")).distinct()
    numbered = _numbered(projects, "path").withColumn("i", F.col("i") + 1)
    events = table(spark, d, "events")
    there = events.join(F.broadcast(numbered), F.col("user_id") % 60 == F.col("i")).select(F.when(F.col("event_id") % 3 == 0, F.col("path")).otherwise(F.concat("path", F.lit("/sub/x"))).alias("cwd"))
    folders = there.union(events.select(F.concat(F.lit("/home/u"), "user_id"))).distinct()
    return corpus.census(folders, projects)
